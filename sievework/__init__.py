"""Evidence analytics on Spark: DataFrame operators for captured pages, names, sources and rankings."""

import sys

from pyspark import cloudpickle

# Python steps travel with their code, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
