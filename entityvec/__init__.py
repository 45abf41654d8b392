"""Entity-labelled vector datasets on Spark: ids, splits, neighbours, triplets, retrieval."""

import sys

from pyspark import cloudpickle

# Arrow kernels travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
