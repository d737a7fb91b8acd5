"""convolake — Spark-native analytics and training-data curation for a
conversational assistant platform.

Every operator is a function from DataFrames (plus small parameter tables
or dicts) to a DataFrame.  Nothing is collected to the driver; the heavy
lifting is Catalyst-planned DataFrame work (filters, joins, windows,
aggregations, higher-order functions), with ``mapInPandas`` only for the
binary decoders and keyed streaming state for the turn machine.
"""

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (mapInPandas,
# pandas UDFs, keyed state) are shipped by value, so executors do not need
# the package installed or on their path.
import sys as _sys

try:  # pragma: no cover - depends on the installed pyspark
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference pickling
    pass
