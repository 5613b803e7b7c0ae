"""Operators for large-scale training-data preparation."""

from pyspark import cloudpickle

import merchlake

# Tasks get the functions with the query, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(merchlake)
