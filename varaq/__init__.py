"""varaq: document layout, text repair and publishing operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code: those need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
