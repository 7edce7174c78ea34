"""A PySpark-native engine for curating, formatting, packing and scoring instruction-tuning data."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
