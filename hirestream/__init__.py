"""hirestream: job-posting and application analytics as Spark DataFrame, SQL and
Structured Streaming operators."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions travel with the job: executors need not have this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
