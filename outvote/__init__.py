"""Consensus outlier detection as Spark jobs."""

import sys

from pyspark import cloudpickle

# Kernels run inside Spark tasks; shipping them by value means executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
