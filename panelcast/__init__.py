"""Segmented count forecasting on panel data, as Spark DataFrame jobs.

The library is a set of DataFrame -> DataFrame functions:

* ``sources``    record readers (drifting CSV layouts, Parquet tables) and sinks
* ``functions``  column expressions: dates, text, rounding, error metrics, arrays
* ``operators``  panel construction, features, splits, profiling, reports, cube
* ``models``     seasonal naive, ridge, blend, boosted trees, recursive forecast
* ``plans``      whole runs built from the above, and the catalogue of queries
"""

KEYS = ("district", "unit")
TIME = "month"
TARGET = "y"
AREA = "area_mode"
