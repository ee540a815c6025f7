"""coppice: a PySpark-native engine of DataFrame-to-DataFrame operators.

Functions that run in Python workers are pickled by value, so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
