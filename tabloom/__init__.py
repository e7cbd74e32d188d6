"""A PySpark-native engine for statistics-driven profiling, generation, validation and plan comparison.

Functions of this package that run on executors are pickled by value, so a cluster needs no copy of the package on
its workers' path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
