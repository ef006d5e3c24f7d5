"""Operators that prepare text for training language models; one module each.

Functions of this package travel to the executors by value, so that Python workers need
no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
