"""Expressions over a short array of past values (one series' history)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last(values: Column, n) -> Column:
    """The last ``n`` elements, or all of them when there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    size = F.size(values)
    return F.slice(values, F.greatest(size - n + 1, F.lit(1)), F.greatest(F.least(size, n), F.lit(0)))


def back(values: Column, k: int) -> Column:
    """The k-th value from the end, null when the history is shorter."""
    return F.try_element_at(values, F.lit(-k))


def sum_of(values: Column) -> Column:
    """Sum of the non-null values, 0.0 when there are none."""
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v.cast("double"), F.lit(0.0)))


def count_of(values: Column) -> Column:
    """Number of non-null values."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + v.isNotNull().cast("long"))


def mean(values: Column) -> Column:
    """Mean of the non-null values, null when there are none."""
    return F.try_divide(sum_of(values), count_of(values))


def deviation(values: Column) -> Column:
    """Sample deviation of the non-null values, null below two; steps in the order of Spark's own aggregate."""

    def step(acc: Column, v: Column) -> Column:
        n = acc["n"] + F.lit(1.0)
        delta = v - acc["mean"]
        part = delta / n
        return F.struct(n.alias("n"), (acc["mean"] + part).alias("mean"), (acc["m2"] + delta * (delta - part)).alias("m2"))

    nothing = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def close(acc: Column) -> Column:
        return F.when(acc["n"] > 1.0, F.sqrt(acc["m2"] / (acc["n"] - 1.0)))

    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), nothing, step, close)


def quantile(ascending: Column, q: float) -> Column:
    """Linearly interpolated quantile of a sorted array; null when it is empty."""
    place = (F.size(ascending) - 1) * F.lit(q)
    below = F.floor(place).cast("int")
    low = F.get(ascending, below).cast("double")
    high = F.coalesce(F.get(ascending, below + 1).cast("double"), low)
    return low + (high - low) * (place - below)
