"""Page-layout and dialogue analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
