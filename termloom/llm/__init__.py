"""Operators for building training data: counting, filtering, deduplication, scoring, formatting.

Nothing else in the package imports this subpackage. Functions of it that
run inside Python workers are pickled by value, so that executors need no
copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
