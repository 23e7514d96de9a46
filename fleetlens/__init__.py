"""Fleet-wide analytics over database workload telemetry and schema metadata, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
