"""Peerwake: event studies on relative moves, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the few Arrow helpers by value, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
