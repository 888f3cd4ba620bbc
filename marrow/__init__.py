"""Retrieval-based text classification and run analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that workers need not have it on
# their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
