"""loomfield: search and work analytics on PySpark DataFrames.

Functions passed to Spark are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
