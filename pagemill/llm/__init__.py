"""Operators of a training-data pipeline (deduplication, search, extraction, mixing, classifiers).

Nothing else in the library imports this package. Its functions are shipped to
the executors by value, so workers need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
