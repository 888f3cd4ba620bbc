"""Operators for building training corpora.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin registered queries.
"""

import sys

from pyspark import cloudpickle

# Functions and classes of this folder travel to executors by value, so that workers
# need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
