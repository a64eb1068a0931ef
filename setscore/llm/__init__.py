"""Operators of a training-data pipeline: contamination, quality, secrets, licences, language,
personal data, sharding, archives, near-duplicates and source mixing.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
