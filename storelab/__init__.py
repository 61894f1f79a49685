"""App-store analytics on Spark: cleaning, features, models, scores and scoreboards."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of the package travel to the workers with their code, so the workers need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
