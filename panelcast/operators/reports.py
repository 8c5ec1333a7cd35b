"""Accuracy tables and indicator reports over actual and forecast values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast import KEYS, TARGET, TIME
from panelcast.functions import metrics, text
from panelcast.functions.numeric import accuracy_band, clamp, half_even
from panelcast.functions.shape import unfold
from panelcast.operators.split import in_years

# Half-width of the band drawn around monthly totals, marker scaling, label width.
CHART_MARGIN = 0.10
MARKER_LOW, MARKER_HIGH, MARKER_SCALE = 8.0, 40.0, 5000.0
LABEL_WIDTH = 12
RESIDUAL_BINS = 60


def predictions_table(
    df: DataFrame, naive: Column, linear: Column, blend: Column, keys=KEYS, time=TIME, target=TARGET
) -> DataFrame:
    """Actual values, each model's forecast to one decimal, signed and percentage error of the blend."""
    rounded = df.select(
        time,
        *keys,
        target,
        half_even(naive, 1).alias("naive"),
        half_even(linear, 1).alias("linear"),
        half_even(blend, 1).alias("blend"),
    )
    error = half_even(F.col(target) - F.col("blend"), 1)
    with_error = rounded.withColumn("error", error)
    percent = F.when(F.col(target) > 0, F.abs(F.col("error")) / F.col(target) * 100.0)
    return with_error.withColumn("error_pct", half_even(percent, 1))


def attach_predictions(actuals: DataFrame, predictions: DataFrame, keys=KEYS, time=TIME) -> DataFrame:
    """Join forecasts to actuals by series and month."""
    return actuals.join(predictions, [*keys, time])


def metrics_by_model(
    predictions: DataFrame, models: dict[str, str], period: str, target: str = TARGET, digits: int | None = 2
) -> DataFrame:
    """MAE, RMSE and WMAPE per model, with the test period as part of the key.

    The models' forecasts are columns of one table, so all are scored in one pass.
    """
    y = F.col(target)
    measures = {"mae": metrics.mae, "rmse": metrics.rmse, "wmape": metrics.wmape}
    wide = predictions.agg(
        *[
            measure(y, F.col(column)).alias(f"{name}_{column}")
            for column in models.values()
            for name, measure in measures.items()
        ]
    )

    def value(name: str, column: str) -> Column:
        result = F.col(f"{name}_{column}")
        return result if digits is None else half_even(result, digits)

    rows = [
        {"model": F.lit(label), "period": F.lit(period), **{name: value(name, c) for name in measures}}
        for label, c in models.items()
    ]
    return unfold(wide, rows)


def holdout_metrics(predictions: DataFrame, forecast: str, target: str = TARGET) -> DataFrame:
    """R2, RMSE, WMAPE and MAE of whole-number forecasts (what the published indicators use)."""
    y, p = F.col(target), half_even(F.col(forecast), 0)
    return predictions.agg(
        half_even(metrics.r2(y, p), 2).alias("r2"),
        half_even(metrics.rmse(y, p), 1).alias("rmse"),
        half_even(metrics.wmape(y, p, on_zero=0), 2).alias("wmape"),
        half_even(metrics.mae(y, p), 1).alias("mae"),
    )


def upsert_metrics(old: DataFrame, new: DataFrame, on: tuple[str, ...] = ("model", "period")) -> DataFrame:
    """Replace the rows of the same model and period, append the rest."""
    return old.join(new, list(on), "left_anti").unionByName(new)


def monthly_actual_vs_forecast(predictions: DataFrame, forecast: str, time=TIME, target=TARGET) -> DataFrame:
    totals = predictions.groupBy(time).agg(F.sum(target).alias("actual"), F.sum(forecast).alias("forecast"))
    return totals.withColumns(
        {
            "lo": F.col("forecast") * F.lit(1.0 - CHART_MARGIN),
            "hi": F.col("forecast") * F.lit(1.0 + CHART_MARGIN),
        }
    )


def segment_summary(predictions: DataFrame, forecast: str, by=(KEYS[0],), target=TARGET) -> DataFrame:
    """Totals and WMAPE per segment in one aggregate."""
    y, p = F.col(target), F.col(forecast)
    return predictions.groupBy(*by).agg(
        F.sum(y).alias("actual"), F.sum(p).alias("forecast"), half_even(metrics.wmape(y, p, on_zero=0), 1).alias("wmape")
    )


def unit_table(predictions: DataFrame, forecast: str, keys=KEYS, target=TARGET) -> DataFrame:
    """Yearly totals per series, the forecast as a whole number, and the absolute difference."""
    y, p = F.col(target), F.col(forecast)
    sums = predictions.groupBy(*keys).agg(
        F.sum(y).alias("actual"),
        half_even(F.sum(p), 0).cast("long").alias("forecast"),
        half_even(metrics.wmape(y, p, on_zero=0), 1).alias("wmape"),
    )
    return sums.withColumn("abs_error", F.abs(F.col("actual") - F.col("forecast")))


def largest(df: DataFrame, n: int, volume: str, ties: list[str]) -> DataFrame:
    """Top ``n`` rows by volume; equal volumes are ordered by name."""
    return df.orderBy(F.col(volume).desc(), *ties).limit(n)


def top_segments(predictions: DataFrame, n: int, by: str = KEYS[0], target=TARGET) -> DataFrame:
    volumes = predictions.groupBy(by).agg(F.sum(target).alias("_volume"))
    return largest(volumes, n, "_volume", [by]).select(by)


def monthly_top_segments(
    predictions: DataFrame, forecast: str, n: int = 5, by: str = KEYS[0], time=TIME, target=TARGET
) -> DataFrame:
    """Monthly totals of the largest segments.

    Totals come first: the semi join then meets one row per segment and month,
    not every row of the largest segments.
    """
    totals = predictions.groupBy(time, by).agg(F.sum(target).alias("actual"), F.sum(forecast).alias("forecast"))
    return totals.join(top_segments(predictions, n, by, target), by, "left_semi")


def accuracy_topn(summary: DataFrame, n: int, by: str = KEYS[0]) -> DataFrame:
    """The ``n`` largest segments, best accuracy first, each with its class."""
    top = largest(summary, n, "actual", [by])
    return top.withColumn("band", accuracy_band(F.col("wmape"))).orderBy("wmape", by)


def accuracy_bands(summary: DataFrame) -> DataFrame:
    """Segments and volume per accuracy class, with their shares."""
    bands = summary.groupBy(accuracy_band(F.col("wmape")).alias("band")).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("actual").alias("volume")
    )
    # At most three rows reach this window.
    every = Window.partitionBy(F.lit(0))
    share = lambda c: half_even(F.try_divide(F.col(c), F.sum(c).over(every)) * 100.0, 1)
    return bands.withColumns({"segments_pct": share("segments"), "volume_pct": share("volume")})


def scatter_points(summary: DataFrame, by: str = KEYS[0]) -> DataFrame:
    """Volume against accuracy: short label, marker size, class."""
    return summary.select(
        by,
        text.short_label(F.col(by), LABEL_WIDTH).alias("label"),
        "actual",
        "wmape",
        clamp(F.col("actual") / F.lit(MARKER_SCALE), MARKER_LOW, MARKER_HIGH).alias("size"),
        accuracy_band(F.col("wmape")).alias("band"),
    )


def label_format(summary: DataFrame, by: str = KEYS[0]) -> DataFrame:
    """Display strings: title-cased name, grouped thousands, percentage."""
    return summary.select(
        by,
        text.title_case(F.col(by)).alias("title"),
        text.short_label(F.col(by), LABEL_WIDTH).alias("label"),
        text.thousands(F.col("actual")).alias("volume_text"),
        text.percent(F.col("wmape")).alias("wmape_text"),
    )


def yearly_totals(panel: DataFrame, time=TIME, target=TARGET) -> DataFrame:
    return panel.groupBy(F.year(time).alias("year")).agg(F.sum(target).alias("cases"))


def yearly_trend(panel: DataFrame, time=TIME, target=TARGET) -> DataFrame:
    """Totals per complete year (all twelve months observed) and their change in percent (0 for the first)."""
    months = panel.groupBy(time).agg(F.sum(target).alias("cases"))
    years = months.groupBy(F.year(time).alias("year")).agg(F.sum("cases").alias("cases"), F.count("*").alias("months"))
    totals = years.filter("months = 12").drop("months")
    # One row per year reaches this window.
    before = F.lag("cases").over(Window.partitionBy(F.lit(0)).orderBy("year"))
    change = half_even(F.try_divide(F.col("cases") - before, before) * 100.0, 1)
    return totals.withColumn("change_pct", F.coalesce(change, F.lit(0.0)))


def kpis(
    predictions: DataFrame, panel: DataFrame, forecast: str, test_year: int, keys=KEYS, time=TIME, target=TARGET
) -> DataFrame:
    """The indicator row: volume, growth, accuracy, segments, history.

    Each table is reduced once; the history's row joins as scalar subqueries.
    """
    y, p = F.col(target), F.col(forecast)
    # One row per series first, so the distinct counts run on few rows.
    per_series = predictions.groupBy(*keys).agg(
        F.sum(y).alias("cases"),
        F.sum(F.abs(y - p)).alias("abs_error"),
        F.sum(F.abs(y)).alias("abs_cases"),
        F.count(F.lit(1)).alias("cells"),
    )
    years = yearly_totals(panel, time, target).agg(
        F.struct(
            F.sum("cases").alias("total"),
            F.count(F.lit(1)).alias("years"),
            F.sum(F.when(F.col("year") == test_year - 1, F.col("cases"))).alias("before"),
        ).alias("history")
    )
    row = per_series.agg(
        F.sum("cases").alias("cases"),
        F.sum("abs_error").alias("abs_error"),
        F.sum("abs_cases").alias("abs_cases"),
        F.sum("cells").alias("cells"),
        F.countDistinct(keys[0]).alias("districts"),
        F.countDistinct(keys[1]).alias("units"),
    ).withColumn("history", years.scalar())
    before = F.coalesce(F.col("history.before"), F.lit(0))
    growth = half_even(F.try_divide(F.col("cases") - before, before) * 100.0, 1)
    error = F.try_divide(F.col("abs_error"), F.col("abs_cases")) * 100.0
    return row.select(
        F.col("cases").alias("cases_test_year"),
        F.coalesce(growth, F.lit(0.0)).alias("growth_pct"),
        half_even(F.coalesce(error, F.lit(0.0)), 2).alias("wmape"),
        half_even(F.col("abs_error") / F.col("cells"), 1).alias("mae"),
        "districts",
        "units",
        F.col("history.total").alias("cases_history"),
        F.col("history.years").alias("years_history"),
    )


def residual_pairs(predictions: DataFrame, forecast: str, target=TARGET) -> DataFrame:
    return predictions.select(F.col(forecast).alias("forecast"), (F.col(target) - F.col(forecast)).alias("residual"))


def residual_histogram(predictions: DataFrame, forecast: str, target=TARGET, bins: int = RESIDUAL_BINS) -> DataFrame:
    """Equal-width histogram of residuals: every bin, its edges and its count.

    The largest residual belongs to the last bin. With a single value there is no
    width, and everything is in the first bin.
    """
    residuals = residual_pairs(predictions, forecast, target)
    edges = residuals.agg(F.min("residual").alias("lo"), F.max("residual").alias("hi"))
    placed = residuals.withColumn("edges", edges.select(F.struct("lo", "hi").alias("edges")).scalar())
    lo, hi = F.col("edges.lo"), F.col("edges.hi")
    place = F.coalesce(F.floor(F.try_divide(F.col("residual") - lo, hi - lo) * F.lit(float(bins))), F.lit(0))
    bucket = F.least(place, F.lit(bins - 1)) + 1
    counts = placed.groupBy(bucket.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = edges.where("lo is not null").withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    frame = every.select("bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("low"), (F.col("lo") + width * F.col("bin")).alias("high"))
    return frame.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def forecast_totals(forecast: DataFrame, value: str = "forecast", time=TIME) -> DataFrame:
    """Monthly totals of a forecast, with its first-half and full totals on every row."""
    months = forecast.groupBy(time).agg(F.sum(value).alias("total"))
    # One row per forecast month reaches these windows.
    ordered = Window.partitionBy(F.lit(0)).orderBy(time)
    every = Window.partitionBy(F.lit(0))
    numbered = months.withColumn("_step", F.row_number().over(ordered))
    return numbered.select(
        time,
        "total",
        F.sum(F.when(F.col("_step") <= 6, F.col("total"))).over(every).alias("first_half"),
        F.sum("total").over(every).alias("full_year"),
    )
