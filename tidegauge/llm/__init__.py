"""Operators for preparing language-model training data; nothing outside imports them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the job, so that workers
# need no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
