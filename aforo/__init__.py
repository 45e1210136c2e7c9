"""Billing analytics for PySpark: feature tables, models, series and panels as DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors do
# not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
