"""Product-catalogue data work as Spark DataFrame jobs."""
import sys

from pyspark.cloudpickle import register_pickle_by_value

# The few functions that run in Python workers travel with the job; executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
