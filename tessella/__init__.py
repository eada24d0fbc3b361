"""tessella: topic-corpus analytics expressed as Spark DataFrame plans.

Functions sent to executors are pickled by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
