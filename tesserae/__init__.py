"""Document retrieval and corpus analytics on Spark DataFrames.

Functions of this package that run in Python workers travel by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
