"""Operators for preparing training text. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
