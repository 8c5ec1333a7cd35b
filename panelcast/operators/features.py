"""Window measures of a series' past, and the sixteen base features."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelcast import AREA, KEYS, TARGET, TIME
from panelcast.functions import arrays

# Lags, window lengths, court recess months, flagged years, flagged area.
LAGS = (1, 2, 3, 6, 12)
WINDOWS = (3, 6, 12)
RECESS_MONTHS = (1, 7)
FLAG_YEARS = (2020, 2021)
FLAG_AREA = "Cível"

LAG_FEATURES = [f"lag_{k}" for k in LAGS]
ROLLING_FEATURES = [*[f"rolling_mean_{w}" for w in WINDOWS], "rolling_std_3"]
CALENDAR_FEATURES = ["month_of_year", "quarter", "is_recess", "is_flag_year", "month_sin", "month_cos"]
BASE_FEATURES = [*LAG_FEATURES, *ROLLING_FEATURES, *CALENDAR_FEATURES, "area_flag"]


@dataclass(frozen=True)
class CalendarRules:
    """What the calendar flags mean; the year flag is switched off when forecasting."""

    recess_months: tuple[int, ...] = RECESS_MONTHS
    flag_years: tuple[int, ...] = FLAG_YEARS
    flag_area: str = FLAG_AREA
    pi: float = math.pi


class SeriesPast:
    """Measures over the earlier rows of each series, every one computed once.

    Feature functions ask for measures and combine the columns they get back.
    ``apply`` adds all requested measures together, so however many features
    use them there is one exchange and one sort per series, and no measure is
    evaluated twice.
    """

    def __init__(self, keys: tuple[str, ...] = KEYS, time: str = TIME, target: str = TARGET):
        self.keys, self.time, self.target = keys, time, target
        self.measures: dict[str, Column] = {}
        self.derived: dict[str, Column] = {}

    def _order(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.time)

    def _past(self, rows: int, skip: int = 0) -> WindowSpec:
        return self._order().rowsBetween(-rows - skip, -1 - skip)

    def _all_past(self) -> WindowSpec:
        return self._order().rowsBetween(Window.unboundedPreceding, -1)

    def _measure(self, name: str, column: Column) -> Column:
        self.measures.setdefault(f"_{name}", column)
        return F.col(f"_{name}")

    def lag(self, k: int) -> Column:
        return self._measure(f"lag_{k}", F.lag(self.target, k).over(self._order()))

    def lag_of(self, column: str, k: int) -> Column:
        return self._measure(f"{column}_lag_{k}", F.lag(column, k).over(self._order()))

    def mean(self, rows: int) -> Column:
        return self._measure(f"mean_{rows}", F.avg(self.target).over(self._past(rows)))

    def std(self, rows: int, skip: int = 0) -> Column:
        """Sample deviation of ``rows`` past rows, as it stood ``skip`` rows ago; null below two values."""
        return self._measure(f"std_{rows}_{skip}", F.stddev_samp(self.target).over(self._past(rows, skip)))

    def sorted_values(self, rows: int, longest: int) -> Column:
        """The past values of a window in ascending order, as an array.

        All windows are cut from one list of the longest. Interpolating in such
        a list is some ten times faster than a percentile aggregate per frame.
        """
        recent = self._measure(f"last_{longest}", F.collect_list(self.target).over(self._past(longest)))
        self.derived.setdefault(f"_sorted_{rows}", F.sort_array(arrays.last(recent, rows)))
        return F.col(f"_sorted_{rows}")

    def rows(self, rows: int) -> Column:
        return self._measure(f"rows_{rows}", F.count(F.lit(1)).over(self._past(rows)))

    def sum(self, rows: int) -> Column:
        return self._measure(f"sum_{rows}", F.sum(self.target).over(self._past(rows)))

    def count(self, rows: int) -> Column:
        return self._measure(f"count_{rows}", F.count(self.target).over(self._past(rows)))

    def sum_all(self) -> Column:
        return self._measure("sum_all", F.sum(self.target).over(self._all_past()))

    def count_all(self) -> Column:
        return self._measure("count_all", F.count(self.target).over(self._all_past()))

    def mean_all(self) -> Column:
        return self._measure("mean_all", F.avg(self.target).over(self._all_past()))

    def mean_same_month(self, period: int) -> Column:
        """Past mean of the same calendar month: another sort, but the same layout."""
        same = Window.partitionBy(*self.keys, F.month(self.time) % F.lit(period)).orderBy(self.time)
        frame = same.rowsBetween(Window.unboundedPreceding, -1)
        return self._measure(f"mean_same_{period}", F.avg(self.target).over(frame))

    def apply(self, df: DataFrame, features: dict[str, Column]) -> DataFrame:
        measured = df.withColumns(self.measures)
        if self.derived:
            measured = measured.withColumns(self.derived)
        return measured.withColumns(features).drop(*self.measures, *self.derived)


def lag_features(past: SeriesPast, lags=LAGS) -> dict[str, Column]:
    return {f"lag_{k}": past.lag(k) for k in lags}


def rolling_features(past: SeriesPast, windows=WINDOWS) -> dict[str, Column]:
    return {**{f"rolling_mean_{w}": past.mean(w) for w in windows}, "rolling_std_3": past.std(3)}


def calendar_features(time: str = TIME, rules: CalendarRules = CalendarRules()) -> dict[str, Column]:
    month, year = F.month(time), F.year(time)
    angle = F.lit(2.0 * rules.pi) * month / F.lit(12.0)
    flagged = year.isin(*rules.flag_years) if rules.flag_years else F.lit(False)
    return {
        "month_of_year": month,
        "quarter": F.quarter(time),
        "is_recess": month.isin(*rules.recess_months).cast("int"),
        "is_flag_year": flagged.cast("int"),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }


def area_features(rules: CalendarRules = CalendarRules()) -> dict[str, Column]:
    """One for series whose area is the flagged one; an unknown area counts as another area."""
    return {"area_flag": F.coalesce(F.col(AREA) == rules.flag_area, F.lit(False)).cast("int")}


def base_features(past: SeriesPast, rules: CalendarRules = CalendarRules()) -> dict[str, Column]:
    return {
        **lag_features(past),
        **rolling_features(past),
        **calendar_features(past.time, rules),
        **area_features(rules),
    }


def add_lags(df: DataFrame, keys=KEYS, time=TIME, target=TARGET, lags=LAGS) -> DataFrame:
    """Values ``k`` rows back within the series (rows, not calendar months)."""
    past = SeriesPast(keys, time, target)
    return past.apply(df, lag_features(past, lags))


def add_rolling(df: DataFrame, keys=KEYS, time=TIME, target=TARGET, windows=WINDOWS) -> DataFrame:
    """Means over the past ``w`` rows and the sample deviation over the past three."""
    past = SeriesPast(keys, time, target)
    return past.apply(df, rolling_features(past, windows))


def add_calendar(df: DataFrame, time=TIME, rules: CalendarRules = CalendarRules()) -> DataFrame:
    return df.withColumns(calendar_features(time, rules))


def add_base_features(
    df: DataFrame, keys=KEYS, time=TIME, target=TARGET, rules: CalendarRules = CalendarRules()
) -> DataFrame:
    """All sixteen base features in one window pass."""
    past = SeriesPast(keys, time, target)
    return past.apply(df, base_features(past, rules))
