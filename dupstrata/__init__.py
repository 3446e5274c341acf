"""dupstrata: data-deduplication analytics as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
