"""Corpus retrieval and knowledge integration as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in tasks travel with their code: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
