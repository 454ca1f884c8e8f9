"""Operators for building training data; nothing else in the library imports this subpackage.

Functions that run in tasks are pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
