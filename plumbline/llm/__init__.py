"""Operators for training-data pipelines: mixing, decontamination, scans, dedup, search, sharding."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its helpers travel with each task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
