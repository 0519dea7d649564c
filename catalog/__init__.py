"""Registered queries: each runs one operator on the given tables, most with an equal SQL text."""

import sys

from pyspark import cloudpickle

from catalog import daily, evaluation, files, pairs, products, refresh, similarity, texts, vectors  # noqa: F401
from catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

# Stand-in models and file writers travel with the job, as the library's task functions do.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
