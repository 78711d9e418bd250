"""docspark: documents, text search and change data on Spark DataFrames.

Python functions of this package travel to executors by value, so a cluster
needs only the third-party libraries installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
