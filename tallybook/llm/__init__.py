"""Operators for text corpora: filters, near-duplicate search, tokenizing, packing, lookups.

Their task functions travel by value, so that executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
