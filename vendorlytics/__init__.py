"""vendorlytics: multi-vendor retail analytics as Spark jobs.

Every query is computed for all vendors at once with DataFrame operations;
see README.md for the layout and the scale notes.
"""

import sys

from vendorlytics.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]

# The per-partition helpers (mapInPandas / applyInPandas) are shipped to the
# Python workers by value, so executors need not have this package installed
# or on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference
    pass
