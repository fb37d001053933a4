"""Operators for preparing training text, one module each, and the queries that apply them.

Nothing outside this package imports it. Functions that run inside tasks are sent to the
workers by value, so executors need the Python libraries but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
