"""catalog_engine: DataFrame operators for curating a large hierarchical catalogue."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
