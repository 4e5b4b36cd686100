"""bioquery: a Spark-native analytics engine for multi-channel signal recordings."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so
# executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
