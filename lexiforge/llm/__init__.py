"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage. Functions that run inside
Python workers are shipped by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
