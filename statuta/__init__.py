"""Set-at-a-time regulatory text analytics on Spark.

Every operator takes and returns DataFrames (or Columns); rule and question
catalogues are small driver-side tables that are compiled into Columns.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that run in Python workers travel by value: executors need no copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
