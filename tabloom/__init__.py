"""tabloom: tabular analysis operators on Spark DataFrames.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects and leaves
planning to Catalyst. Modules:

* ``tabloom.sources``    scans, sinks and the dataset catalog
* ``tabloom.operators``  relational, profiling, cleaning, statistics, ML,
  forecasting and fault-diagnosis operators
* ``tabloom.functions``  column expressions and distribution functions
* ``tabloom.plans``      recorded analysis replay and the registered queries
* ``tabloom.streaming``  operators that also run on streaming DataFrames
"""

import sys

from pyspark import cloudpickle

from tabloom.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"

# Functions that run in Python workers travel by value: executors need no copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
