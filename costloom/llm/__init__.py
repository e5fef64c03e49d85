"""Operators of a training-data pipeline over documents, labels and benchmarks.

Nothing outside this folder imports it; ``costloom.llm.catalog`` registers its queries.
Functions that run in tasks travel with the job, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
