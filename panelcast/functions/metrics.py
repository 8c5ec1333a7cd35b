"""Forecast error measures as aggregate expressions.

Each function returns an aggregate column, so any grouping can use it in one
``agg`` next to others; partial sums are merged before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mae(actual: Column, forecast: Column) -> Column:
    return F.avg(F.abs(actual - forecast))


def rmse(actual: Column, forecast: Column) -> Column:
    error = actual - forecast
    return F.sqrt(F.avg(error * error))


def wmape(actual: Column, forecast: Column, on_zero: float | None = None) -> Column:
    """Sum of absolute errors over sum of absolute actuals, in percent.

    ``on_zero`` is the value when all actuals are zero: null (the training
    reports) or 0 (the published tables).
    """
    value = F.try_divide(F.sum(F.abs(actual - forecast)), F.sum(F.abs(actual))) * F.lit(100.0)
    return value if on_zero is None else F.coalesce(value, F.lit(float(on_zero)))


def r2(actual: Column, forecast: Column) -> Column:
    """1 - SSres/SStot in one pass; 0 when the actuals do not vary.

    The variance aggregate keeps central moments, so a large mean does not
    cancel the digits of SStot.
    """
    error = actual - forecast
    spread = F.var_pop(actual) * F.count(actual)
    return F.when(spread > 0, F.lit(1.0) - F.sum(error * error) / spread).otherwise(F.lit(0.0))
