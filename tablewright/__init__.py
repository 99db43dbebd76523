"""Table analytics on Spark: profile, clean, aggregate, model, forecast, monitor.

Every operator is a plain function: DataFrame in, DataFrame out.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers are pickled by value, so executors do not need the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
