"""feedloom: enrich and search short posts with PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job needs no
# package installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
