"""Spark-native analytics over versioned public notices."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
