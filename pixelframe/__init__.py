"""pixelframe: image measurement, acquisition catalogues and message streams as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in tasks carry their code with them, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
