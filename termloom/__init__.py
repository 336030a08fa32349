"""Term intelligence on Spark: pages to terms, terms to merged, tiered and grouped entities.

Functions that run inside Python workers are pickled by value, so that
executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
