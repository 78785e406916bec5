import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from pyspark import cloudpickle

import voicegrain
from voicegrain.session import build_session

cloudpickle.register_pickle_by_value(voicegrain)


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "4g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-"),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
