"""Training-data operators: search, packing, mixing, quality rules, sharding,
language ID, PII sanitisation, substring / suffix / n-gram Jaccard dedup.

Nothing else in the library imports this subpackage.  Its functions are
shipped to executors by value, so they need no copy of the library there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
