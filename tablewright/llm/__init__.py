"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Functions that run inside Python workers are pickled by value, so executors do not need the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
