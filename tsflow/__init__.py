"""tsflow: time-series preparation, forecasting and evaluation as Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` function with explicit key and
order columns (a Spark DataFrame has no file order).  Sub-packages:

* ``sources``   – readers with declared schemas, fixtures derived from the driver tables
* ``functions`` – Column-level helpers (calendar features, safe division, hash draws, sin/cos codes)
* ``operators`` – splits, scaling, windows, series features, metrics, M4 scoring, forecasters, results
* ``plans``     – the registered queries and their DuckDB oracle SQL
* ``streaming`` – the reference has no streaming; see its docstring
"""

from tsflow.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
