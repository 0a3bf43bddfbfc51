"""Operators of a training-data pipeline; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
