"""Catalogue, search and recommendation jobs on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value: no file has to be shipped with a job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
