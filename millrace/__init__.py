"""millrace: a Spark-native engine for automated analytics on tables and text.

Operators are functions from DataFrame to DataFrame; fitted operators are small
objects holding scalars or lookup tables and an ``apply`` method.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
