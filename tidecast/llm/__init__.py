"""Operators of a training-data pipeline; ``catalog`` registers one query for each of them.

The functions that run in Python workers travel with their tasks, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
