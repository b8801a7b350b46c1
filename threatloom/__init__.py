"""Code-security analytics on Spark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors with their code, which then need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
