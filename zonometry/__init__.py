"""zonometry: small-area composite indexes as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The small per-row solves travel with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
