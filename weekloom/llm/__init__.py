"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions for the executors travel by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
