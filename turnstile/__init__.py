"""turnstile: a Spark-native engine for conversation, preference and judge data.

Operators are functions from DataFrame to DataFrame (or Column builders) over
built-in Spark expressions; see ``turnstile.operators``.
"""

import sys as _sys

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions and classes *by value* inside Python UDFs.

    Executors then run the UDF helpers (XML parsing, bin packing, backends)
    without having ``turnstile`` installed or on their path; only PySpark and
    the usual scientific stack are needed on the workers.
    """
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except (ImportError, AttributeError, ValueError):  # pragma: no cover - older cloudpickle
        pass


_ship_by_value()
