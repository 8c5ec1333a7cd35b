"""Profiling of raw records: volumes, top lists, distributions, column overview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast import KEYS, TIME
from panelcast.functions import dates
from panelcast.functions.numeric import half_even
from panelcast.functions.shape import unfold
from panelcast.operators.reports import largest

DATE = "received_at"


def column_overview(df: DataFrame) -> DataFrame:
    """Type, missing values and distinct values of every column.

    Each column is counted on its own, reading only that column: values are
    grouped (reduced map-side, so a frequent value is no burden), then the
    groups are counted. Counting all distinct values in one aggregate would
    copy every row once per column.
    """

    def one(position: int, name: str, dtype: str) -> DataFrame:
        groups = df.groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        counts = groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("v").alias("distinct_values"),
        )
        return counts.select(
            F.lit(position).alias("position"),
            F.lit(name).alias("column"),
            F.lit(dtype).alias("type"),
            "nulls",
            half_even(F.try_divide(F.col("nulls"), F.col("rows")) * 100.0, 2).alias("nulls_pct"),
            "distinct_values",
        )

    parts = [one(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    return reduce(DataFrame.unionByName, parts)


# Logarithm of a sketch's number of registers: 4,096 give a standard error of 1.6 %.
SKETCH_BITS = 12


def column_sketches(df: DataFrame, by: list[str] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """Rows, nulls and a sketch of the distinct values of every column (per group), all in one scan.

    Sketches have a fixed size and can be stored, per file or day for instance, and united later
    (:func:`sketched_overview`). Rows are (``by``, position, column, type, rows, nulls, sketch). Values are
    sketched by their text, so those that print alike count once; a null is no value.
    """
    by = by or []
    columns = [(name, dtype) for name, dtype in df.dtypes if name not in by]
    counted = [F.count(F.lit(1)).alias("_rows")]
    for i, (name, _) in enumerate(columns):
        text = F.col(name).cast("string")
        counted += [F.count(name).alias(f"_n{i}"), F.hll_sketch_agg(text, F.lit(bits)).alias(f"_s{i}")]
    wide = df.groupBy(*by).agg(*counted)
    rows = [
        {
            **{b: F.col(b) for b in by},
            "position": F.lit(i),
            "column": F.lit(name),
            "type": F.lit(dtype),
            "rows": F.col("_rows"),
            "nulls": F.col("_rows") - F.col(f"_n{i}"),
            "sketch": F.col(f"_s{i}"),
        }
        for i, (name, dtype) in enumerate(columns)
    ]
    return unfold(wide, rows)


def sketched_overview(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """:func:`column_overview` from sketches, those of all groups united; with ``by`` per group of these columns.

    Distinct values are estimates; the same sketches in any grouping give the same ones.
    """
    by = by or []
    united = sketches.groupBy(*by, "position", "column", "type").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("sketch").alias("sketch")
    )
    share = half_even(F.try_divide(F.col("nulls"), F.col("rows")) * 100.0, 2)
    distinct = F.hll_sketch_estimate("sketch").alias("distinct_values")
    return united.select(*by, "position", "column", "type", "nulls", share.alias("nulls_pct"), distinct)


def _segments(records: DataFrame) -> DataFrame:
    """Row counts per year, segments and area: what the distinct counts need, on few rows."""
    return records.groupBy(F.year(DATE).alias("year"), *KEYS, "area").agg(F.count(F.lit(1)).alias("n"))


def yearly_cardinality(records: DataFrame) -> DataFrame:
    """Rows and distinct segments and areas per year."""
    return _segments(records).groupBy("year").agg(
        F.sum("n").alias("cases"),
        F.countDistinct("district").alias("districts"),
        F.countDistinct("unit").alias("units"),
        F.countDistinct("area").alias("areas"),
    )


def value_counts(records: DataFrame, column: str) -> DataFrame:
    """Count and share per value; rows without a value count in the denominator only."""
    counts = records.groupBy(column).agg(F.count(F.lit(1)).alias("cases"))
    total = counts.agg(F.sum("cases").alias("total")).scalar()
    share = half_even(F.col("cases") / total * 100.0, 2)
    return counts.withColumn("share_pct", share).filter(F.col(column).isNotNull())


def top_values(records: DataFrame, column: str, n: int = 15) -> DataFrame:
    return largest(value_counts(records, column), n, "cases", [column])


def volume_by(records: DataFrame, period: Column, name: str) -> DataFrame:
    return records.groupBy(period.alias(name)).agg(F.count(F.lit(1)).alias("cases"))


def monthly_volume(records: DataFrame) -> DataFrame:
    return volume_by(records, dates.month_label(F.col(DATE)), "month")


def yearly_volume(records: DataFrame) -> DataFrame:
    return volume_by(records, F.year(DATE), "year")


def heatmap(records: DataFrame) -> DataFrame:
    """Year by month table of counts, empty cells 0."""
    months = list(range(1, 13))
    dated = records.select(F.year(DATE).alias("year"), F.month(DATE).alias("m"))
    counts = dated.groupBy("year").pivot("m", months).agg(F.count(F.lit(1)))
    return counts.select("year", *[F.coalesce(F.col(str(m)), F.lit(0)).alias(f"m{m:02d}") for m in months])


def district_month_quartiles(records: DataFrame, n: int = 10, column: str = KEYS[0]) -> DataFrame:
    """Five-number summary of monthly counts for the ``n`` largest segments."""
    monthly = records.groupBy(column, dates.month_of(F.col(DATE)).alias(TIME)).agg(F.count(F.lit(1)).alias("cases"))
    volumes = monthly.groupBy(column).agg(F.sum("cases").alias("_volume"))
    # Null values are no segment; the top list leaves them out.
    top = largest(volumes.filter(F.col(column).isNotNull()), n, "_volume", [column]).select(column)
    five = F.percentile("cases", [0.0, 0.25, 0.5, 0.75, 1.0])
    summary = monthly.join(top, column, "left_semi").groupBy(column).agg(five.alias("_five"))
    names = ["minimum", "q25", "median", "q75", "maximum"]
    return summary.select(column, *[F.get("_five", F.lit(i)).alias(name) for i, name in enumerate(names)])


def summary(records: DataFrame) -> DataFrame:
    """One row over everything: rows, period, distinct segments, missing amounts."""
    missing = F.count_if(F.col("value").isNull())
    reduced = records.groupBy(*KEYS, "area").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(DATE).alias("first"),
        F.max(DATE).alias("last"),
        missing.alias("missing"),
    )
    return reduced.agg(
        F.sum("n").alias("records"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.countDistinct("district").alias("districts"),
        F.countDistinct("unit").alias("units"),
        F.countDistinct("area").alias("areas"),
        half_even(F.sum("missing") / F.sum("n") * 100.0, 2).alias("value_nulls_pct"),
    )
