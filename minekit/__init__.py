"""Data-mining operators for keyed wide tables, expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# the small functions that run inside tasks travel by value, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
