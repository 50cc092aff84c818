"""lattica: partition-aware analytics on PySpark.

Functions that run on executors are pickled by value, so a job needs nothing
installed on the executors beyond PySpark, pandas and pyarrow.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
