"""Operators for training-data corpora. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# What tasks run in Python travels with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
