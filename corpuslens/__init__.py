"""Corpus quality and detector analytics as Spark jobs.

Every operator is a function from DataFrames to DataFrames.  Nothing here keeps
its own engine: plans are declared with the DataFrame API and Catalyst picks the
physical form.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
