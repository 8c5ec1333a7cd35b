"""Out-of-time split: warm-up rows dropped, training years, test year, leakage check."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast import TIME


def month_date(year: int, month_no: int) -> dt.date:
    return dt.date(year, month_no, 1)


def in_years(time: str = TIME, first: int | None = None, last: int | None = None) -> Column:
    """Year range as a comparison on the month itself, which Parquet scans can skip files by."""
    condition = F.lit(True)
    if first is not None:
        condition = condition & (F.col(time) >= F.lit(dt.date(first, 1, 1)))
    if last is not None:
        condition = condition & (F.col(time) < F.lit(dt.date(last + 1, 1, 1)))
    return condition


def drop_warmup(features: DataFrame) -> DataFrame:
    """Drop rows with a missing lag or rolling value: the first twelve of every series."""
    warm = [c for c in features.columns if c.startswith(("lag_", "rolling_"))]
    return features.dropna(subset=warm)


def train_part(features: DataFrame, last_year: int, time: str = TIME) -> DataFrame:
    return drop_warmup(features).filter(in_years(time, last=last_year))


def test_part(features: DataFrame, year: int, time: str = TIME) -> DataFrame:
    return drop_warmup(features).filter(in_years(time, first=year, last=year))


def leakage(clean: DataFrame, last_train_year: int, test_year: int, time: str = TIME) -> DataFrame:
    """Last training month, first test month and whether they are in order, in one pass."""
    train, test = in_years(time, last=last_train_year), in_years(time, first=test_year, last=test_year)
    edges = clean.agg(
        F.max(F.when(train, F.col(time))).alias("train_last"),
        F.min(F.when(test, F.col(time))).alias("test_first"),
    )
    return edges.withColumn("in_order", F.col("train_last") < F.col("test_first"))


def assert_no_leakage(clean: DataFrame, last_train_year: int, test_year: int, time: str = TIME) -> None:
    row = leakage(clean, last_train_year, test_year, time).first()
    if not row["in_order"]:
        raise ValueError(f"training data reaches {row['train_last']}, test data starts at {row['test_first']}")


def split_summary(features: DataFrame, last_train_year: int, test_year: int, time: str = TIME) -> DataFrame:
    """Size of both parts, their months, and the rows lost to warm-up: one pass over the features."""
    warm = [c for c in features.columns if c.startswith(("lag_", "rolling_"))]
    usable = F.lit(True)
    for c in warm:
        usable = usable & F.col(c).isNotNull()
    train = usable & in_years(time, last=last_train_year)
    test = usable & in_years(time, first=test_year, last=test_year)
    # Months are few: grouping by them first leaves one small row per month to summarise.
    by_month = features.groupBy(time).agg(
        F.count_if(~usable).alias("dropped"), F.count_if(train).alias("train"), F.count_if(test).alias("test")
    )
    in_train, in_test = F.col("train") > 0, F.col("test") > 0
    return by_month.agg(
        F.sum("train").alias("train_rows"),
        F.sum("test").alias("test_rows"),
        F.sum("dropped").alias("dropped_rows"),
        F.min(F.when(in_train, F.year(time))).alias("train_first_year"),
        F.count_if(in_train).alias("train_months"),
        F.count_if(in_test).alias("test_months"),
    )
