"""Code-estate assessment and warehouse ETL patterns as plain Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to Python workers travel whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
