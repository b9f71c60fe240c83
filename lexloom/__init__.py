"""Localisation-corpus analytics and typed-record queries as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a cluster
# needs no installed copy of it there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
