"""Dates: lenient parsing, month keys, month sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-digit years follow the POSIX rule: 69..99 are 19xx, 00..68 are 20xx.
FIRST_WRAPPED_YEAR = 2069


def parse_short_date(text: Column) -> Column:
    """``d/m/yy`` text to a date; anything else becomes null instead of failing.

    Day and month may be unpadded; four-digit years are refused. Spark reads
    ``yy`` as 20xx, so years from 2069 on are moved back a century.
    """
    parsed = F.try_to_timestamp(text, F.lit("d/M/yy")).cast("date")
    return F.when(F.year(parsed) >= FIRST_WRAPPED_YEAR, F.add_months(parsed, -1200)).otherwise(parsed)


def parse_day_first(text: Column) -> Column:
    """The profiling loader's parser: day-first text with two- or four-digit year, or ISO text."""
    return F.coalesce(
        parse_short_date(text),
        F.try_to_timestamp(text, F.lit("d/M/yyyy")).cast("date"),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"),
    )


def month_of(date: Column) -> Column:
    """First day of the month, the panel's time key."""
    return F.trunc(date, "MM")


def month_label(month: Column) -> Column:
    """``YYYY-MM`` text form of a month."""
    return F.date_format(month, "yyyy-MM")


def month_range(first: Column, last: Column) -> Column:
    """All months from first to last as an array."""
    return F.sequence(first, last, F.expr("interval 1 month"))


def month_index(month: Column, epoch_year: int) -> Column:
    """Whole months since January of ``epoch_year``."""
    return (F.year(month) - F.lit(epoch_year)) * 12 + F.month(month) - 1
