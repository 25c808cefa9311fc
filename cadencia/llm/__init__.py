"""Operators for preparing language-model training data. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so a cluster needs no copy of it on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
