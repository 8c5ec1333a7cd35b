"""A series' history as one short row: enough for the features of its next month, advanced by arithmetic.

:class:`StatePast` answers the same questions as ``SeriesPast``, from the arrays and totals of such a row
instead of windows over the panel, so the feature functions serve both and give the same values.
A state is as wide for a series of ten years as for one of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast import AREA, KEYS, TARGET, TIME
from panelcast.functions import arrays
from panelcast.operators import extended
from panelcast.operators.features import BASE_FEATURES, LAGS, WINDOWS, CalendarRules, SeriesPast, base_features
from panelcast.operators.panel import series_list

SEASON = 12
# Values that a feature may look back: the longest change, or a shifted deviation.
DEPTH = max(1 + max(extended.CHANGE_PERIODS), max(extended.STD_LAGS) + 3, *LAGS, *WINDOWS, extended.CROSS_WINDOW)
# Flags of earlier rows that the anomaly count of the next row takes in.
FLAGS = extended.RECENT_ANOMALIES - 1

# Columns of a state besides the keys, the month to come and the area.
STATE = ["recent", "rows", "total", "known", "month_totals", "month_counts", "level", "slope", "flags"]


class StatePast(SeriesPast):
    """Measures over the past that a state row sums up."""

    def _last(self, rows: int, skip: int = 0) -> Column:
        values = F.col("recent")
        if skip:
            values = F.slice(values, F.lit(1), F.greatest(F.size(values) - skip, F.lit(0)))
        return arrays.last(values, rows)

    def lag(self, k: int) -> Column:
        return self._measure(f"lag_{k}", arrays.back(F.col("recent"), k))

    def lag_of(self, column: str, k: int) -> Column:
        raise NotImplementedError("a state keeps values of the target only")

    def mean(self, rows: int) -> Column:
        return self._measure(f"mean_{rows}", arrays.mean(self._last(rows)))

    def std(self, rows: int, skip: int = 0) -> Column:
        return self._measure(f"std_{rows}_{skip}", arrays.deviation(self._last(rows, skip)))

    def sorted_values(self, rows: int, longest: int) -> Column:
        there = F.filter(self._last(longest), lambda v: v.isNotNull())
        recent = self._measure(f"last_{longest}", there)
        self.derived.setdefault(f"_sorted_{rows}", F.sort_array(arrays.last(recent, rows)))
        return F.col(f"_sorted_{rows}")

    def rows(self, rows: int) -> Column:
        return self._measure(f"rows_{rows}", F.least(F.col("rows"), F.lit(rows).cast("long")))

    def sum(self, rows: int) -> Column:
        return self._measure(f"sum_{rows}", arrays.sum_of(self._last(rows)))

    def count(self, rows: int) -> Column:
        return self._measure(f"count_{rows}", arrays.count_of(self._last(rows)))

    def sum_all(self) -> Column:
        return self._measure("sum_all", F.col("total"))

    def count_all(self) -> Column:
        return self._measure("count_all", F.col("known"))

    def mean_all(self) -> Column:
        return self._measure("mean_all", F.try_divide("total", "known"))

    def mean_same_month(self, period: int) -> Column:
        if period != SEASON:
            raise ValueError(f"a state keeps totals for a period of {SEASON} months")
        place = F.month(self.time) % SEASON
        return self._measure(f"mean_same_{period}", F.try_divide(F.get("month_totals", place), F.get("month_counts", place)))


def _smoothed(level: Column, slope: Column, value: Column) -> tuple[Column, Column]:
    """One step of double exponential smoothing."""
    alpha, beta = F.lit(extended.HOLT_ALPHA), F.lit(extended.HOLT_BETA)
    up = alpha * value + (F.lit(1.0) - alpha) * (level + slope)
    return up, beta * (up - level) + (F.lit(1.0) - beta) * slope


def _flag(past_values: Column) -> Column:
    """Was the last of these values an outlier of the year that ends with it."""
    year = arrays.last(past_values, extended.ANOMALY_WINDOW)
    distance = arrays.back(past_values, 1) - arrays.mean(year)
    score = F.abs(distance / (arrays.deviation(year) + F.lit(extended.EPSILON)))
    return F.coalesce((score > extended.ANOMALY_THRESHOLD).cast("int"), F.lit(0))


def start(panel: DataFrame, keys=KEYS, time=TIME, target=TARGET) -> DataFrame:
    """The state of every series after its last row; ``time`` is the month after the panel's last.

    The only pass over the history. A series brings one row per month to its group, as after
    counting. An empty panel has no states; missing values take a place but no weight.
    """
    cell = F.struct(F.col(time).alias("t"), F.col(target).cast("double").alias("y"))
    gathered = panel.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    gathered = gathered.withColumn("_y", F.transform("_cells", lambda c: c["y"]))
    n = F.size("_y")

    def of_month(m: Column) -> Column:
        own = F.filter("_cells", lambda c: F.month(c["t"]) % SEASON == m)
        return F.transform(own, lambda c: c["y"])

    def step(state: Column, value: Column) -> Column:
        up, slope = _smoothed(state["level"], state["slope"], value)
        return F.struct(up.alias("level"), slope.alias("slope"))

    first = F.get("_y", F.lit(0))
    begun = F.struct(first.alias("level"), (F.get("_y", F.lit(1)) - first).alias("slope"))
    holt = F.aggregate(F.slice("_y", F.lit(2), F.greatest(n - 1, F.lit(0))), begun, step)
    months = F.sequence(F.lit(0), F.lit(SEASON - 1))
    latest = F.sequence(F.greatest(n - FLAGS, F.lit(0)), n - 1)
    states = gathered.withColumn("_holt", holt).select(
        *keys,
        arrays.last(F.col("_y"), DEPTH).alias("recent"),
        n.cast("long").alias("rows"),
        arrays.sum_of(F.col("_y")).alias("total"),
        arrays.count_of(F.col("_y")).alias("known"),
        F.transform(months, lambda m: arrays.sum_of(of_month(m))).alias("month_totals"),
        F.transform(months, lambda m: arrays.count_of(of_month(m))).alias("month_counts"),
        F.col("_holt.level").alias("level"),
        F.col("_holt.slope").alias("slope"),
        F.transform(latest, lambda j: _flag(F.slice("_y", F.lit(1), j))).alias("flags"),
    )
    opened = F.add_months(panel.agg(F.max(time)).scalar(), 1)
    return states.join(series_list(panel, keys), list(keys)).withColumn(time, opened)


class NextMonth:
    """Adds the features of the month to come to states, missing ones zero.

    They are what ``add_all_features`` (``wide``) or ``add_base_features`` gives for a row without value added at
    the end of every series. Cross-segment means run over the states, one short row per series;
    states are read several times for them, so they should be ``durable``. The expressions
    are put together once and serve every month.
    """

    def __init__(
        self,
        keys=KEYS,
        time=TIME,
        rules: CalendarRules = CalendarRules(),
        epoch_year: int = extended.EPOCH_YEAR,
        wide: bool = True,
    ):
        self.keys, self.wide = list(keys), wide
        self.past = past = StatePast(keys, time, "")
        features = base_features(past, rules)
        if wide:
            features |= {
                **extended.fourier_features(time, epoch_year=epoch_year),
                **extended.quantile_features(past),
                **extended.trend_features(past),
                **extended.seasonal_features(past),
                **extended.volatility_features(past),
                **extended.change_features(past),
                **extended.row_order_features(past),
                "holt_level": F.col("level"),
                "holt_slope": F.col("slope"),
            }
            # One flag per state, beside the measures: its count takes it in.
            flag = past._measure("flag", _flag(F.col("recent")))
            earlier = F.aggregate("flags", F.lit(0), lambda total, one: total + one)
            features |= {"is_anomaly": flag, "anomaly_count_6m": (earlier + flag).cast("long")}
        names = {*BASE_FEATURES, *(extended.EXTENDED_FEATURES + extended.AUXILIARY_FEATURES if wide else [])}
        self.features = [(F.coalesce(c, F.lit(0)) if name in names else c).alias(name) for name, c in features.items()]
        # The row to come takes a place among the last rows of its series.
        tail = arrays.last(F.concat("recent", F.array(F.lit(None).cast("double"))), extended.CROSS_WINDOW)
        self.series = [*self.keys, F.col("total").alias("sum"), F.col("known").alias("n"), tail.alias("tail")]

    def __call__(self, states: DataFrame) -> DataFrame:
        known = states
        if self.wide:
            known = states.join(extended.carried_from(states.select(*self.series), self.keys), self.keys)
        measured = known.withColumns(self.past.measures)
        if self.past.derived:
            measured = measured.withColumns(self.past.derived)
        return measured.select(*states.columns, *self.features)


def next_features(states: DataFrame, *args, **kwargs) -> DataFrame:
    """:class:`NextMonth` for one month."""
    return NextMonth(*args, **kwargs)(states)


def advance(states: DataFrame, value: Column, time=TIME) -> DataFrame:
    """The states one month on, after ``value`` has been seen for their month to come. Other columns stay."""
    moved = states.withColumn("_v", value.cast("double"))
    v, place = F.col("_v"), F.month(time) % SEASON
    seen = F.coalesce(v, F.lit(0.0))
    # The second value of a series makes its first slope.
    slope = F.when(F.col("rows") == 1, v - F.col("level")).otherwise(F.col("slope"))
    up, tilt = _smoothed(F.col("level"), slope, v)
    grown = F.concat("recent", F.array(v))
    return moved.withColumns(
        {
            # The flag of the row that is filled now speaks of the value before it.
            "flags": arrays.last(F.concat("flags", F.array(_flag(F.col("recent")))), FLAGS),
            "recent": arrays.last(grown, DEPTH),
            "rows": F.col("rows") + 1,
            "total": F.col("total") + seen,
            "known": F.col("known") + v.isNotNull().cast("long"),
            "month_totals": F.transform("month_totals", lambda s, m: F.when(m == place, s + seen).otherwise(s)),
            "month_counts": F.transform(
                "month_counts", lambda c, m: F.when(m == place, c + v.isNotNull().cast("long")).otherwise(c)
            ),
            "level": up,
            "slope": tilt,
            time: F.add_months(time, 1),
        }
    ).drop("_v")
