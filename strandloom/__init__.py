"""Track linkage, scene scoring and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

#: Functions of the package travel to the executors by value, so that the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
