"""Operators for training-data pipelines. Each module takes and returns DataFrames; nothing outside this package
imports it."""

import sys

from pyspark import cloudpickle

# Task functions travel by value: executors need Python's libraries, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
