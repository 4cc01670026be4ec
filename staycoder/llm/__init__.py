"""Operators for preparing large training corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the executors by value, which need not have the library installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
