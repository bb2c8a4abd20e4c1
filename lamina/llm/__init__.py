"""Operators of a training-data pipeline: search, tokenising, quality, dedup, mixing, scoring, sharding."""

import sys

from pyspark import cloudpickle

# Functions go to Python workers by value: a cluster's workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
