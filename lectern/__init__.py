"""Lectern: a Spark-native document corpus, linking and search library."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
