"""Time-series analytics and forecasting evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: the small helpers used inside
# pandas functions travel with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
