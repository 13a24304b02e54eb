"""Second-order knockoff feature analysis as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Arrow kernels defined in this package travel to the executors by value, so a
# job needs neither --py-files nor an installed copy on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
