"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# Task functions carry the code of this subpackage with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
