"""Media-curation analytics as plain PySpark DataFrame and streaming jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run inside tasks travel with them, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
