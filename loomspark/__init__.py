"""Property-graph analytics over document collections, expressed as Spark DataFrames.

Functions of this package that run on executors are pickled by value, so executors need no
installed copy of it.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
