"""Operators of a training-data pipeline over documents, pages and vectors.

Functions of this subpackage that run in tasks travel by value, so executors
need no copy of it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
