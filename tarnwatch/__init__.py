"""Spark operators for monitoring mountain lakes, and for preparing text corpora.

Every operator takes DataFrames and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
