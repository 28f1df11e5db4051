"""Spark-first analytics over snapshots of crawled web pages."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the plan, so executors need
# pyspark, pyarrow, numpy and pandas, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
