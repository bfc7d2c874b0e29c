"""kataflow: corpus vocabulary and training-data operators on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle

import kataflow as _self

# Functions sent to Python workers travel by value, so that executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_self)
