"""Training-data operators.

Nothing else in the library imports this package; it may import the library's
general helpers.  Operators read only the columns they name, so extra columns
of an input, whatever they are called, never reach their internals.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the library
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
