"""Operators for preparing training corpora; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# What tasks run is sent to them with the task, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
