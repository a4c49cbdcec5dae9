"""Training-data operators: search, deduplication, filtering, scoring and mixing.

Nothing else in the library imports this subpackage. Its functions run on
executors that need not have the package installed: they are sent by value.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
