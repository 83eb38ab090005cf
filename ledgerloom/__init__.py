"""Ledgerloom: typed, reconciled tables from messy document-derived rows, as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
