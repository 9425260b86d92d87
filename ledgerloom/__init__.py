"""Ledger quality, anomaly detection, document reading and audit as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run inside tasks travel with them, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
