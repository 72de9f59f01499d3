"""Operators for preparing large text corpora: dedup, search, scans, mixing.

Nothing else in ``castleflow`` imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Workers get the functions themselves, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
