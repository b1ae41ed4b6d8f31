"""Operators for preparing text corpora for model training.

Nothing else in the package imports this one. The functions that run on executors are pickled by value, so executors need the
third-party libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
