"""chromaloom: single-cell imaging measurements as Spark tables and plans."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors with their closure, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
