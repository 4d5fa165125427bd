"""Orientational order in two-dimensional data, as Spark DataFrame operators.

Functions of this package that run in executors travel with the task, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
