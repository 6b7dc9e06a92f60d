"""Text-index analytics on Spark DataFrames: suffix structures, substring search, repeats, matches and factors."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with the plan, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
