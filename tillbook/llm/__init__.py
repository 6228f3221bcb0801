"""Operators that prepare text corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so that executors need not
# have the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
