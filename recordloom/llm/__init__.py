"""Operators for preparing training data: tokens, filters, duplicates, search and packing.

Functions of this package run inside Python workers. They are shipped with the tasks
that use them, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
