"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Its functions run inside
Python workers on the executors, so the package is pickled by value: workers
need only the third-party libraries, not a copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
