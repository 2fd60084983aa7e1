"""Operators of a large training-data pipeline; nothing else in the library imports them.

Functions that run in executors are pickled with their modules, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
