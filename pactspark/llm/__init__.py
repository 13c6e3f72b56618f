"""Training-data operators: quality, deduplication, extraction, mixing, tokens.

Nothing else in the library imports this subpackage; ``queries`` registers its
operators with the driver entry module. Functions that run on executors are
pickled by value, so executors need no copy of this package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
