"""Operators for preparing training text. Nothing else in the library imports this folder.

Code that runs in Python workers travels with its task, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
