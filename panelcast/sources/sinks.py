"""Sinks: partitioned tables, single-row JSON summaries, the split cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast import KEYS, TIME
from panelcast.operators.cube import ALL, MONTH_NAMES

# Files per year: enough for parallel writes and scans, not one per task.
FILES_PER_YEAR = 16

# Folders of a stored cube, and files in each: a segment lies in one folder, its units in several files.
CUBE_BUCKETS = 16
FILES_PER_BUCKET = 4
_CELL = "struct<actual: bigint, forecast: bigint, lo: bigint, hi: bigint>"


def write_by_year(df: DataFrame, path: str, time: str = TIME, keys=KEYS, files: int = FILES_PER_YEAR) -> None:
    """Parquet partitioned by year, so year filters prune whole folders.

    Rows are dealt out by year and a bucket of the series first: a year has at most
    ``files`` files, whatever the number of tasks.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(files))
    dated = df.withColumn("year", F.year(time)).withColumn("_bucket", bucket)
    dealt = dated.repartition("year", "_bucket").drop("_bucket")
    dealt.write.mode("overwrite").partitionBy("year").parquet(path)


def read_by_year(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A table of :func:`write_by_year`; only the folders of the years from ``first`` to ``last`` are opened."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col("year") >= first)
    if last is not None:
        df = df.filter(F.col("year") <= last)
    return df.drop("year")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with nulls kept, for summaries and indicators."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_cube(cube_documents: DataFrame, path: str) -> None:
    """One JSON document per member (segment and unit) in two folders, ``bucket=1`` and ``bucket=2``."""
    cube_documents.write.mode("overwrite").partitionBy("bucket").option("ignoreNullFields", False).json(path)


def _cube_bucket(segment: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(segment), F.lit(buckets)).cast("int")


def write_cube_table(
    cube: DataFrame, path: str, keys=KEYS, buckets: int = CUBE_BUCKETS, files: int = FILES_PER_BUCKET
) -> None:
    """The cube as Parquet that slices prune: folders by ``part`` and by ``bucket`` of the outer segment.

    ``part=totals`` holds the ALL members, ``part=units`` the rest, so totals stay small beside any number
    of units. A segment with very many units is dealt over ``files`` files, each sorted by member and month,
    so statistics inside the files prune the rest.
    """
    outer, inner = keys
    part = F.when(F.col(inner) == ALL, "totals").otherwise("units")
    placed = cube.withColumns({"part": part, "bucket": _cube_bucket(F.col(outer), buckets)})
    dealt = placed.withColumn("_file", F.pmod(F.xxhash64(inner), F.lit(files))).repartition("part", "bucket", "_file").drop("_file")
    ordered = dealt.sortWithinPartitions("part", "bucket", outer, inner, "year", "month_no")
    ordered.write.mode("overwrite").partitionBy("part", "bucket").parquet(path)


def read_cube_table(
    spark: SparkSession, path: str, segment: str | None = None, totals: bool = False, keys=KEYS, buckets: int = CUBE_BUCKETS
) -> DataFrame:
    """A stored cube; of a ``segment`` only its folders are opened, with ``totals`` only those of ALL members.

    ``buckets`` is the number the table was written with.
    """
    rows = spark.read.parquet(path)
    if segment is not None:
        rows = rows.filter(F.col("bucket") == _cube_bucket(F.lit(segment), buckets)).filter(F.col(keys[0]) == segment)
    if totals:
        rows = rows.filter(F.col("part") == "totals")
    return rows.drop("part", "bucket")


def read_cube(spark: SparkSession, path: str, keys=KEYS) -> DataFrame:
    """Both halves of :func:`write_cube` as one long table: a row per member and month, as the cube has it.

    ``bucket`` tells the half. Months come back by name and number; a document with no year has no rows.
    """
    outer, inner = keys
    schema = f"`{outer}` string, `{inner}` string, document string, bucket int"
    months = f"map<string, map<string, {_CELL}>>"
    rows = spark.read.schema(schema).json(path).withColumn("years", F.from_json("document", months))
    by_year = rows.select("bucket", outer, inner, F.explode("years").alias("year", "months"))
    cells = by_year.select("bucket", outer, inner, F.col("year").cast("int"), F.explode("months").alias("month_name", "cell"))
    number = F.array_position(F.array(*[F.lit(name) for name in MONTH_NAMES]), F.col("month_name")).cast("int")
    return cells.select("bucket", outer, inner, "year", number.alias("month_no"), "month_name", "cell.*")


def write_cube_tree(fragments: DataFrame, path: str, keys=KEYS) -> None:
    """The nested document of each half as text: the files of ``bucket=1`` (or 2), in order of name, spell it.

    Fragments (:func:`panelcast.operators.cube.cube_tree`) are sorted by ranges, so files are written in parallel
    and no task holds a document.
    """
    order = ("bucket", *keys)
    ordered = fragments.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("bucket", "fragment").write.mode("overwrite").partitionBy("bucket").text(path)
