"""Session settings that the operators rely on, and reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # row_number() <= k is pruned before the shuffle for every k the jobs use
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # so many wanted keys reach a parquet scan as they are, not as the range they span
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
}

_local_folders: dict[str, str] = {}


def build_session(app: str = "voicegrain", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _base_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where driver and executors are one process may it be a folder of the machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="voicegrain-checkpoint-")
    return _local_folders[context.applicationId]


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{_base_folder(spark)}/voicegrain-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, so that later stages,
    and executors lost during them, never recompute what came before."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_base_folder(df.sparkSession))
    return df.checkpoint(eager=True)
