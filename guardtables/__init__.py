"""Inspection and audit of AI traffic held in Spark tables and streams."""
import sys

from pyspark import cloudpickle

# Python functions travel with the plan, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
