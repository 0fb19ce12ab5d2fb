"""Trace analytics and generative trace modelling as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Spark's Python workers travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
