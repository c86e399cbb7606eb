"""Operators for preparing language-model training data. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# The workers get these modules' functions by value, so that they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
