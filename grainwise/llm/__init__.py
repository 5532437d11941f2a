"""Operators of a training-data pipeline over text and vector tables."""

import sys

from pyspark import cloudpickle

# tasks carry the functions they run: workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
