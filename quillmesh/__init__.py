"""quillmesh: document-integrity analytics as set-at-a-time PySpark plans."""

import sys

from pyspark import cloudpickle

# Functions go to Python workers by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
