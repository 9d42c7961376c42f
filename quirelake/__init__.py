"""Citation-evidence analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their own code, so that the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
