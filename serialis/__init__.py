"""Serialis: a catalog, search, delivery-planning and retention engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with the job, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
