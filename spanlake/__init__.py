"""spanlake: building, searching and measuring bounded context from text corpora on Spark.

Functions that run in Python workers are pickled by value, so that workers need
only third-party libraries and no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
