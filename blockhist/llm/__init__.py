"""Operators for large text corpora used in training: one module per operator.

Every operator takes DataFrames and returns DataFrames. Its own interface keeps texts, spans and
scores; ``queries.py`` derives the registered digest queries from them.
"""

import sys

from pyspark import cloudpickle

# Tasks receive the code of this package with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
