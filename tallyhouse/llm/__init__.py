"""Operators of a training-data pipeline: quality, packing, tokenising,
fingerprints, deduplication, rules, license, url and toxicity scans.

Nothing else in the library imports this subpackage. Its registered queries
are in ``queries``, their DuckDB SQL in ``sql``.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: they need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
