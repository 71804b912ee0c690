"""flowscore: Spark-native scoring of network-flow tables with voting ensembles.

Every operator takes and returns a DataFrame (or builds a Column), so it
composes with ``DataFrame.transform`` and lets Catalyst plan the work.
"""

import sys as _sys

# Python code that runs inside tasks (mapInPandas, pandas UDFs, grouped state)
# is shipped with the task: pickle this package's functions and classes by
# value, so executors need no installed copy of it.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with --py-files instead
    pass

from flowscore.session import get_spark, scratch_path  # noqa: E402,F401

__all__ = ["get_spark", "scratch_path"]
