"""Quire: documents as structured, searchable, deduplicated tables, on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors inside the tasks that use them,
# so a cluster needs no --py-files and no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
