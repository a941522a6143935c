"""loomline: document, retrieval and training-data operators on Spark DataFrames."""
import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value: no executor needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
