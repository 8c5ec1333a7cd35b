"""Stages shared by runs and queries, from records to forecasts.

The sparse monthly panel is the one stage every later one reads more than once.
It is written to the checkpoint folder: the raw rows are scanned and joined
once, and everything after works on counts.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.numeric import half_even
from panelcast.models import blend, forecast, naive, ridge
from panelcast.operators import cube, extended, features, panel, reports, split
from panelcast.session import durable, tune_for_wide_tables
from panelcast.sources import tables


@dataclass(frozen=True)
class Setup:
    """Years and flags of one run."""

    last_train_year: int
    test_year: int
    epoch_year: int = extended.EPOCH_YEAR
    rules: features.CalendarRules = field(default_factory=features.CalendarRules)
    alpha: float = blend.DEFAULT_ALPHA
    cube_first_year: int = 2020


# The order tables cover 1995-01 to 2001-08; 2000 is their last full year.
ORDERS = Setup(
    last_train_year=1999,
    test_year=2000,
    epoch_year=1995,
    rules=features.CalendarRules(flag_years=(1998, 1999), flag_area="O"),
    cube_first_year=1995,
)

def sparse_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return durable(panel.monthly_counts(tables.order_records(spark, sf_dir)))


def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.zero_fill(sparse_panel(spark, sf_dir))


def base_table(spark: SparkSession, sf_dir: str, setup: Setup = ORDERS) -> DataFrame:
    return features.add_base_features(dense_panel(spark, sf_dir), rules=setup.rules)


def full_table(spark: SparkSession, sf_dir: str, setup: Setup = ORDERS) -> DataFrame:
    """Base and extended features over the full history, nulls kept so that it can be split."""
    return full_features(dense_panel(spark, sf_dir), setup)


def full_features(dense: DataFrame, setup: Setup = ORDERS, fill_nulls: bool = False) -> DataFrame:
    tune_for_wide_tables(dense.sparkSession)
    return extended.add_all_features(dense, rules=setup.rules, epoch_year=setup.epoch_year, fill_nulls=fill_nulls)


def train_rows(table: DataFrame, setup: Setup = ORDERS) -> DataFrame:
    return split.train_part(table, setup.last_train_year)


def test_rows(table: DataFrame, setup: Setup = ORDERS) -> DataFrame:
    return split.test_part(table, setup.test_year)


def with_forecasts(rows: DataFrame, model: ridge.RidgeModel, alpha: float) -> DataFrame:
    """Unrounded forecasts of the naive, linear and blended model."""
    first = rows.withColumns({"m0": naive.naive_forecast(), "m1": model.forecast()})
    return first.withColumn("m2", blend.blend_forecast(F.col("m0"), F.col("m1"), alpha))


def holdout(spark: SparkSession, sf_dir: str, setup: Setup = ORDERS) -> DataFrame:
    """The test year with all three forecasts, by the published coefficients."""
    rows = test_rows(base_table(spark, sf_dir, setup), setup)
    return with_forecasts(rows, ridge.PUBLISHED, setup.alpha)


def predictions(spark: SparkSession, sf_dir: str, setup: Setup = ORDERS) -> DataFrame:
    rows = holdout(spark, sf_dir, setup)
    return reports.predictions_table(rows, F.col("m0"), F.col("m1"), F.col("m2"))


def cube_of(dense: DataFrame, setup: Setup = ORDERS) -> DataFrame:
    """Cube over history, the naive holdout forecast and the naive forecast beyond the history."""
    rows = test_rows(features.add_base_features(dense, rules=setup.rules), setup)
    keys = [*rows.columns[:2], "month"]
    tested = rows.select(*keys, half_even(naive.naive_forecast(), 0).cast("long").alias("forecast"))
    ahead = forecast.forecast_naive(dense).select(*keys, "forecast")
    until = dense.agg(F.max("month")).first()[0]
    first, last = following_months(until, forecast.HORIZON)
    return cube.forecast_cube(
        dense,
        tested.unionByName(ahead),
        setup.cube_first_year,
        last.year,
        until,
        [(split.month_date(setup.test_year, 1), split.month_date(setup.test_year, 12)), (first, last)],
    )


def following_months(month: dt.date, n: int) -> tuple[dt.date, dt.date]:
    """First and last of the ``n`` months after ``month``."""

    def shift(k: int) -> dt.date:
        years, months = divmod(month.month - 1 + k, 12)
        return dt.date(month.year + years, months + 1, 1)

    return shift(1), shift(n)
