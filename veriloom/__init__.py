"""veriloom: provenance analytics over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
