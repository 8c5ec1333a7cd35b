"""Seasonal naive forecast: the same month one year before."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.functions.numeric import not_negative


def naive_forecast(lag: str = "lag_12") -> Column:
    return not_negative(F.col(lag).cast("double"))
