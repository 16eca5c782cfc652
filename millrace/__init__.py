"""Spark-native engine for the data side of model post-training."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions inside the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
