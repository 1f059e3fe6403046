"""kemptable: table profiling, cleaning and quality gates as Spark jobs.

Every public function takes DataFrames and gives a DataFrame (or a column
expression) back; Spark partitions, shuffles and schedules the work.
"""

import sys

from pyspark import cloudpickle

# Python functions and data sources of this package travel inside the task, so
# executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
