"""The extended feature groups: cycles, quantiles, trend, smoothing, seasonality,
volatility, momentum, cross-segment means and anomalies.

Every ``add_*`` function takes a dense panel and returns it with columns added.
Groups that need nothing but a series' own past describe their features through
:class:`SeriesPast`, so the composite evaluates them all in one window pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast import KEYS, TARGET, TIME
from panelcast.functions import arrays, dates
from panelcast.functions.numeric import EPSILON, fill
from panelcast.operators.features import BASE_FEATURES, WINDOWS, CalendarRules, SeriesPast, base_features
from panelcast.operators.ordering import totals_before
from panelcast.operators.panel import salted_left_join
from panelcast.session import durable

# Parameters of the feature groups.
FOURIER_PERIODS = (12, 6, 4, 3)
FOURIER_ORDERS = (1, 2)
EPOCH_YEAR = 2014
QUANTILES = (0.25, 0.5, 0.75)
HOLT_ALPHA = 0.3
HOLT_BETA = 0.1
STD_LAGS = (1, 2, 3, 6)
CHANGE_PERIODS = (1, 3, 6, 12)
ANOMALY_THRESHOLD = 2.5
ANOMALY_WINDOW = 12
RECENT_ANOMALIES = 6
CROSS_WINDOW = 12

FOURIER_FEATURES = [f"fourier_{p}m_{f}_{k}" for p in FOURIER_PERIODS for k in FOURIER_ORDERS for f in ("sin", "cos")]
QUANTILE_FEATURES = [
    name for w in WINDOWS for name in (*[f"rolling_q{int(q * 100)}_{w}" for q in QUANTILES], f"rolling_iqr_{w}")
]
TREND_FEATURES = [f"{kind}_{w}" for w in WINDOWS for kind in ("detrended", "deviation")]
SEASONAL_FEATURES = ["seasonal_index", "seasonal_index_log"]
VOLATILITY_FEATURES = [*[f"rolling_std_3_lag_{k}" for k in STD_LAGS], "volatility_accel"]
CHANGE_FEATURES = [name for n in CHANGE_PERIODS for name in (f"roc_{n}", f"roc_pct_{n}")]
CROSS_FEATURES = ["district_mean_lag", "deviation_from_district", "unit_district_ratio"]
ANOMALY_FEATURES = ["is_anomaly", "anomaly_count_6m"]
EXTENDED_FEATURES = [
    *FOURIER_FEATURES,
    *QUANTILE_FEATURES,
    *TREND_FEATURES,
    *SEASONAL_FEATURES,
    *VOLATILITY_FEATURES,
    *CHANGE_FEATURES,
    *CROSS_FEATURES,
    *ANOMALY_FEATURES,
]
# Computed on the way and kept in the table, but not given to a model.
AUXILIARY_FEATURES = ["trend_3", "trend_6", "trend_12", "holt_level", "holt_slope", "district_mean", "unit_mean"]
NUMERIC_FEATURES = [*BASE_FEATURES, *EXTENDED_FEATURES]
CATEGORICAL_FEATURES = list(KEYS)
MODEL_FEATURES = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]


# --- cycles ---------------------------------------------------------------


def fourier_features(
    time=TIME, periods=FOURIER_PERIODS, orders=FOURIER_ORDERS, epoch_year=EPOCH_YEAR
) -> dict[str, Column]:
    """Sine and cosine of absolute time, so training and forecasting share the phase."""
    t = dates.month_index(F.col(time), epoch_year)
    columns = {}
    for period in periods:
        for order in orders:
            angle = F.lit(2.0 * math.pi * order) * t / F.lit(float(period))
            columns[f"fourier_{period}m_sin_{order}"] = F.sin(angle)
            columns[f"fourier_{period}m_cos_{order}"] = F.cos(angle)
    return columns


def add_fourier_features(
    df: DataFrame, time=TIME, periods=FOURIER_PERIODS, orders=FOURIER_ORDERS, epoch_year=EPOCH_YEAR
) -> DataFrame:
    return df.withColumns(fourier_features(time, periods, orders, epoch_year))


# --- quantiles ------------------------------------------------------------


def quantile_features(past: SeriesPast, windows=WINDOWS) -> dict[str, Column]:
    """Interpolated quartiles over past rows, and their spread (0 when there is no past)."""
    columns = {}
    for w in windows:
        values = past.sorted_values(w, max(windows))
        low, middle, high = (arrays.quantile(values, q) for q in QUANTILES)
        columns |= dict(zip((f"rolling_q{int(q * 100)}_{w}" for q in QUANTILES), (low, middle, high)))
        columns[f"rolling_iqr_{w}"] = fill(high - low, 0.0)
    return columns


def add_quantile_features(df: DataFrame, keys=KEYS, time=TIME, target=TARGET, windows=WINDOWS) -> DataFrame:
    past = SeriesPast(keys, time, target)
    return past.apply(df, quantile_features(past, windows))


# --- local trend ----------------------------------------------------------


def trend_features(past: SeriesPast, windows=WINDOWS) -> dict[str, Column]:
    """Past mean as local trend, and the last value's signed and absolute distance from it."""
    columns = {}
    for w in windows:
        distance = past.lag(1) - past.mean(w)
        columns[f"trend_{w}"] = past.mean(w)
        columns[f"detrended_{w}"] = distance
        columns[f"deviation_{w}"] = F.abs(distance)
    return columns


def add_detrended_features(df: DataFrame, keys=KEYS, time=TIME, target=TARGET, windows=WINDOWS) -> DataFrame:
    past = SeriesPast(keys, time, target)
    return past.apply(df, trend_features(past, windows))


# --- level and slope ------------------------------------------------------


def add_local_level_slope(
    df: DataFrame, keys=KEYS, time=TIME, target=TARGET, alpha=HOLT_ALPHA, beta=HOLT_BETA
) -> DataFrame:
    """Double exponential smoothing of each series up to the previous month.

    The recursion has no window form, so a series becomes one array in time
    order (its length is the number of months), is folded once, and is unfolded
    with its states. Row 0 has no past and gets (0, 0); row 1 gets the first
    value and the first difference; from row 2 on, the value before the current
    row updates level and slope.
    """
    row = F.struct(time, *[c for c in df.columns if c not in (*keys, time)])
    series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    values = F.transform("_rows", lambda r: r[target].cast("double"))
    first, second = F.get("_y", F.lit(0)), F.get("_y", F.lit(1))

    def state(level: Column, slope: Column) -> Column:
        return F.struct(level.alias("level"), slope.alias("slope"))

    def advance(states: Column, value: Column) -> Column:
        current = F.element_at(states, -1)
        level = F.lit(alpha) * value + F.lit(1.0 - alpha) * (current["level"] + current["slope"])
        slope = F.lit(beta) * (level - current["level"]) + F.lit(1.0 - beta) * current["slope"]
        return F.concat(states, F.array(state(level, slope)))

    # Values 1 .. n-2 lead to the states of rows 2 .. n-1.
    driving = F.slice("_y", F.lit(2), F.greatest(F.size("_y") - 2, F.lit(0)))
    started = F.array(state(first, second - first))
    nothing_yet = F.array(state(F.lit(0.0), F.lit(0.0)))
    states = F.when(
        F.size("_y") > 1, F.concat(nothing_yet, F.aggregate(driving, started, advance))
    ).otherwise(nothing_yet)
    folded = series.withColumn("_y", values).select(*keys, "_rows", states.alias("_states"))
    unfolded = folded.select(*keys, F.explode(F.arrays_zip("_rows", "_states")).alias("_cell"))
    return unfolded.select(
        *[F.col(c) if c in keys else F.col(f"_cell._rows.{c}").alias(c) for c in df.columns],
        F.col("_cell._states.level").alias("holt_level"),
        F.col("_cell._states.slope").alias("holt_slope"),
    )


# --- seasonality ----------------------------------------------------------


def seasonal_features(past: SeriesPast, period: int = 12) -> dict[str, Column]:
    """Past mean of the same calendar month over the past mean of the series, and its logarithm."""
    index = fill(past.mean_same_month(period) / (past.mean_all() + F.lit(EPSILON)), 1.0)
    return {"seasonal_index": index, "seasonal_index_log": F.log(index + F.lit(EPSILON))}


def add_seasonal_indices(df: DataFrame, keys=KEYS, time=TIME, target=TARGET, period: int = 12) -> DataFrame:
    past = SeriesPast(keys, time, target)
    return past.apply(df, seasonal_features(past, period))


# --- volatility -----------------------------------------------------------


def volatility_features(past: SeriesPast, lags=STD_LAGS, std: str | None = None) -> dict[str, Column]:
    """Earlier values of the three-row deviation, and its change since the previous row.

    Without ``std`` the earlier values come straight from shifted frames; with
    it they are lags of that column, as a panel cut at the front needs.
    """
    if std is None:
        now, earlier = past.std(3), lambda k: past.std(3, skip=k)
    else:
        now, earlier = F.col(std), lambda k: past.lag_of(std, k)
    columns = {f"rolling_std_3_lag_{k}": earlier(k) for k in lags}
    return {**columns, "volatility_accel": fill(now - earlier(1), 0.0)}


def add_volatility_dynamics(
    df: DataFrame, keys=KEYS, time=TIME, target=TARGET, lags=STD_LAGS, cross_series_first_row: bool = False
) -> DataFrame:
    """Lagged deviation and its change; an existing ``rolling_std_3`` column is used as it is.

    The change is taken within a series. ``cross_series_first_row`` gives an
    ungrouped difference instead: the first row of a series is compared with
    the last row of the series before it.
    """
    std = "rolling_std_3" if "rolling_std_3" in df.columns else None
    past = SeriesPast(keys, time, target)
    added = past.apply(df, volatility_features(past, lags, std))
    if not cross_series_first_row:
        return added
    if std is None:
        raise ValueError("cross_series_first_row needs the column rolling_std_3")
    edges = df.groupBy(*keys).agg(
        F.min(time).alias("_start"), F.array(F.max_by(std, F.col(time))).alias("last_std")
    )
    edges = durable(edges)
    borders = totals_before(edges, [], list(keys), [], tail="last_std", tail_rows=1)
    joined = added.join(edges.select(*keys, "_start").join(borders, list(keys)), list(keys))
    at_border = F.col(std) - F.get("before_last_std", F.lit(0))
    accel = F.when(F.col(time) == F.col("_start"), fill(at_border, 0.0)).otherwise(F.col("volatility_accel"))
    return joined.withColumn("volatility_accel", accel).drop("_start", "before_last_std")


# --- momentum -------------------------------------------------------------


def change_features(past: SeriesPast, periods=CHANGE_PERIODS) -> dict[str, Column]:
    """Difference of the last value to the one ``n`` rows before it, absolute and in percent."""
    columns = {}
    for n in periods:
        change = past.lag(1) - past.lag(1 + n)
        columns[f"roc_{n}"] = change
        columns[f"roc_pct_{n}"] = fill(change / (past.lag(1 + n) + F.lit(EPSILON)) * F.lit(100.0), 0.0)
    return columns


def add_rate_of_change_features(
    df: DataFrame, keys=KEYS, time=TIME, target=TARGET, periods=CHANGE_PERIODS
) -> DataFrame:
    past = SeriesPast(keys, time, target)
    return past.apply(df, change_features(past, periods))


# --- cross-segment means --------------------------------------------------

CARRIED = ["_outer_sum", "_outer_n", "_tail_sums", "_tail_counts", "_inner_sum", "_inner_n"]


def carried_means(df: DataFrame, keys=KEYS, time=TIME, target=TARGET) -> DataFrame:
    """What the series before each series contribute to its row-order means.

    In row order a segment's running mean goes through its series one after
    the other, each in time order. Everything a row sees of earlier series is
    the same for all rows of its own series, so it is worked out on one short
    row per series and joined once. The series' own totals are written to the
    checkpoint folder, as several branches read them and none should go back to
    the panel; so is the result, which keeps the plan over the panel short.
    """
    outer, inner = keys
    recent = F.sort_array(F.collect_list(F.struct(time, target)))
    series = df.groupBy(outer, inner).agg(
        F.sum(target).alias("sum"),
        F.count(target).alias("n"),
        F.transform(arrays.last(recent, CROSS_WINDOW), lambda r: r[target]).alias("tail"),
    )
    return durable(carried_from(durable(series), keys))


def carried_from(series: DataFrame, keys=KEYS) -> DataFrame:
    """The same from one row per series: its ``sum``, its number ``n`` of values, its last values as ``tail``.

    ``series`` is read several times.
    """
    outer, inner = keys
    by_outer = totals_before(series, [outer], [inner], ["sum", "n"], "tail", CROSS_WINDOW)
    by_inner = totals_before(series, [inner], [outer], ["sum", "n"])
    lengths = F.sequence(F.lit(0), F.lit(CROSS_WINDOW))
    return by_outer.select(
        outer,
        inner,
        F.col("before_sum").alias("_outer_sum"),
        F.col("before_n").alias("_outer_n"),
        # Sum and count of the last k earlier values, for every k a row may still need.
        F.transform(lengths, lambda k: arrays.sum_of(arrays.last(F.col("before_tail"), k))).alias("_tail_sums"),
        F.transform(lengths, lambda k: arrays.count_of(arrays.last(F.col("before_tail"), k))).alias("_tail_counts"),
    ).join(
        by_inner.select(
            outer, inner, F.col("before_sum").alias("_inner_sum"), F.col("before_n").alias("_inner_n")
        ),
        [outer, inner],
    )


def _mean(total: Column, count: Column) -> Column:
    return F.try_divide(total.cast("double"), count.cast("double"))


def _cross_features(past: SeriesPast, district_mean: Column, recent_mean: Column, unit_mean: Column) -> dict[str, Column]:
    return {
        "district_mean": district_mean,
        "district_mean_lag": recent_mean,
        "deviation_from_district": past.lag(1) - district_mean,
        "unit_mean": unit_mean,
        "unit_district_ratio": fill(unit_mean / (district_mean + F.lit(EPSILON)), 1.0),
    }


def row_order_features(past: SeriesPast) -> dict[str, Column]:
    """Cross-segment means of a panel that ``carried_means`` was joined to."""
    own_sum, own_n = fill(past.sum_all(), 0), past.count_all()
    missing = (F.lit(CROSS_WINDOW) - past.rows(CROSS_WINDOW)).cast("int")
    recent_sum = fill(past.sum(CROSS_WINDOW), 0) + F.get("_tail_sums", missing)
    recent_n = past.count(CROSS_WINDOW) + F.get("_tail_counts", missing)
    return _cross_features(
        past,
        _mean(F.col("_outer_sum") + own_sum, F.col("_outer_n") + own_n),
        _mean(recent_sum, recent_n),
        _mean(F.col("_inner_sum") + own_sum, F.col("_inner_n") + own_n),
    )


def _earlier_months(df: DataFrame, segment: str, time: str, target: str, prefix: str) -> DataFrame:
    """Means of a segment over strictly earlier months: all of them, and the last twelve."""
    monthly = df.groupBy(segment, time).agg(F.sum(target).alias("_sum"), F.count(target).alias("_n"))
    order = Window.partitionBy(segment).orderBy(time)
    before, recent = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(-CROSS_WINDOW, -1)
    return monthly.select(
        segment,
        time,
        _mean(F.sum("_sum").over(before), F.sum("_n").over(before)).alias(f"{prefix}_all"),
        _mean(F.sum("_sum").over(recent), F.sum("_n").over(recent)).alias(f"{prefix}_recent"),
    )


def add_cross_sectional_features(
    df: DataFrame, keys=KEYS, time=TIME, target=TARGET, order: str = "series"
) -> DataFrame:
    """Mean level of the outer and inner segment, and the series' distance from it.

    ``order='series'`` runs through a segment series by series, so a later
    series sees future months of the earlier ones. ``order='time'`` uses earlier
    months only and is free of that leak; its short mean covers twelve months.
    """
    outer, inner = keys
    past = SeriesPast(keys, time, target)
    if order == "series":
        joined = df.join(carried_means(df, keys, time, target), [outer, inner])
        return past.apply(joined, row_order_features(past)).drop(*CARRIED)
    if order != "time":
        raise ValueError(f"order must be 'series' or 'time', not {order!r}")
    by_outer = _earlier_months(df, outer, time, target, "_outer")
    by_inner = _earlier_months(df, inner, time, target, "_inner").drop("_inner_recent")
    joined = salted_left_join(df, by_outer, [outer, time], inner)
    joined = salted_left_join(joined, by_inner, [inner, time], outer)
    features = _cross_features(past, F.col("_outer_all"), F.col("_outer_recent"), F.col("_inner_all"))
    return past.apply(joined, features).drop("_outer_all", "_outer_recent", "_inner_all")


# --- anomalies ------------------------------------------------------------


def anomaly_features(past: SeriesPast, threshold: float = ANOMALY_THRESHOLD) -> dict[str, Column]:
    distance = past.lag(1) - past.mean(ANOMALY_WINDOW)
    score = F.abs(distance / (past.std(ANOMALY_WINDOW) + F.lit(EPSILON)))
    return {"is_anomaly": fill((score > threshold).cast("int"), 0)}


def add_recent_anomalies(df: DataFrame, keys=KEYS, time=TIME) -> DataFrame:
    """Flags over the last six rows, the current one included (it speaks of the value before it)."""
    recent = Window.partitionBy(*keys).orderBy(time).rowsBetween(1 - RECENT_ANOMALIES, 0)
    return df.withColumn("anomaly_count_6m", F.sum("is_anomaly").over(recent))


def add_anomaly_features(
    df: DataFrame, keys=KEYS, time=TIME, target=TARGET, threshold: float = ANOMALY_THRESHOLD
) -> DataFrame:
    """Was the previous value an outlier of its own year, and how often recently."""
    past = SeriesPast(keys, time, target)
    return add_recent_anomalies(past.apply(df, anomaly_features(past, threshold)), keys, time)


# --- composite ------------------------------------------------------------


def zero_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers become zero. Infinities cannot occur: no division here has a zero base."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns if c in df.columns})


def add_all_features(
    panel: DataFrame,
    keys=KEYS,
    time=TIME,
    target=TARGET,
    rules: CalendarRules = CalendarRules(),
    epoch_year: int = EPOCH_YEAR,
    order: str = "series",
    fill_nulls: bool = True,
) -> DataFrame:
    """Base and extended features of a dense panel.

    Smoothing runs first, on the narrow panel. What other series contribute is
    joined as one row per series. All remaining groups then share one window
    pass over the layout by series. Missing features become zero afterwards, the
    lags and rolling columns that mark the warm-up rows included; split with
    ``fill_nulls=False`` first if those rows are to be dropped.
    """
    smoothed = add_local_level_slope(panel, keys, time, target)
    past = SeriesPast(keys, time, target)
    features = {
        **base_features(past, rules),
        **fourier_features(time, epoch_year=epoch_year),
        **quantile_features(past),
        **trend_features(past),
        **seasonal_features(past),
        **volatility_features(past),
        **change_features(past),
        **anomaly_features(past),
    }
    if order == "series":
        joined = smoothed.join(carried_means(panel, keys, time, target), list(keys))
        wide = past.apply(joined, {**features, **row_order_features(past)}).drop(*CARRIED)
    else:
        wide = add_cross_sectional_features(past.apply(smoothed, features), keys, time, target, order)
    wide = add_recent_anomalies(wide, keys, time)
    return zero_nulls(wide, [*NUMERIC_FEATURES, *AUXILIARY_FEATURES]) if fill_nulls else wide
