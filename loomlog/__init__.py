"""Job-log analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by ``app_key``, so one Spark
job analyses the event logs of many applications at once.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
