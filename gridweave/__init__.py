"""A PySpark-native engine for planning connections to a utility network."""

import sys

from pyspark import cloudpickle

# Functions of the package travel to the executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
