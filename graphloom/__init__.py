"""Typed dependency graphs on Spark: build, query, check and export them with the DataFrame API."""

__version__ = "0.1.0"

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel with the plan, so a cluster needs no copy of the package.
_cloudpickle.register_pickle_by_value(__import__(__name__))
