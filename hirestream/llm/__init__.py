"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this subpackage; its queries are registered
by ``__spark_entry__`` when it is present.
"""
import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions travel with the job: executors need not have this package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
