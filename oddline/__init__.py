"""oddline: find odd records in log and security-event data with Spark.

Every operator takes DataFrames and returns DataFrames (or, for fitted models,
a small object holding DataFrames and a handful of numbers), so that Catalyst
sees one plan and Spark partitions all the work.
"""

import sys

from pyspark import cloudpickle

# Ship the few task-side functions with the job, so that executors need no
# installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
