"""Operators a training-data pipeline needs, over the ``documents``, ``pages``
and ``embeddings`` tables. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the Python workers by value: an executor needs no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
