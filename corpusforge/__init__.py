"""Text-corpus preparation and evaluation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of UDFs travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
