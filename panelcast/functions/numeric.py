"""Rounding, clipping, error bands and null-safe arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Added to a denominator so that a zero base gives a large number, not an error.
EPSILON = 1e-6

# Digits beyond which a sum of doubles is taken for noise before it is rounded.
NOISE_DIGITS = 9


def half_even(value: Column, digits: int = 0) -> Column:
    """Banker's rounding (0.5 -> 0, 1.5 -> 2), as array libraries round.

    The last bits of a distributed sum depend on the order of its parts. They
    are rounded away first, so that a tie is a tie on every run.
    """
    return F.bround(F.round(value, NOISE_DIGITS), digits)


def not_negative(value: Column) -> Column:
    """Values below zero become zero; null stays null (``greatest`` would turn it into zero)."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def fill(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def band_low(value: Column, margin: float) -> Column:
    """Lower edge of the error band, truncated towards zero and never negative."""
    edge = (value * F.lit(1.0 - margin)).cast("long")
    return F.when(edge < 0, F.lit(0).cast("long")).otherwise(edge)


def band_high(value: Column, margin: float) -> Column:
    return (value * F.lit(1.0 + margin)).cast("long")


def accuracy_band(wmape: Column, good: float = 20.0, poor: float = 35.0) -> Column:
    """Three accuracy classes: below ``good``, below ``poor``, the rest."""
    return (
        F.when(wmape < good, F.lit(f"<{good:g}"))
        .when(wmape < poor, F.lit(f"{good:g}-{poor:g}"))
        .otherwise(F.lit(f">{poor:g}"))
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def total(terms: list[Column]) -> Column:
    """Sum of a fixed list of columns, left to right."""
    return reduce(lambda left, right: left + right, terms)
