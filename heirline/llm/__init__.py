"""Operators for preparing training text.

Functions that run in Python workers are pickled with their code, so the workers need
no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
