"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import voicegrain

# Python workers get these functions with each task, wherever they run.
cloudpickle.register_pickle_by_value(voicegrain)
