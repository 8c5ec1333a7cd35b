"""Running totals along an order of series, without sorting a hot group in one task.

One outer segment may hold a third of all series, so a window over the whole
segment would put them all into one task. The order is therefore cut into
ranges: totals run inside each range in parallel, one row per range carries the
totals across, and both are added. Nothing is dropped and the result is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions import arrays

# Number of ranges; the table of range borders never has more rows than this.
RANGES = 256


def with_range(series: DataFrame, order: list[str], ranges: int = RANGES) -> DataFrame:
    """Add ``_range``, the number of the range of ``order`` a row falls into.

    The borders are the rows with the smallest hashes: an even spread over the
    order that comes out the same whenever it is computed again, as after the
    loss of an executor. They only decide where the order is cut.
    """
    place = F.struct(*order)
    borders = (
        series.select(place.alias("place"))
        .orderBy(F.xxhash64("place"), "place")
        .limit(ranges)
        .agg(F.sort_array(F.collect_list("place")).alias("borders"))
        .scalar()
    )
    at_or_before = F.filter("_borders", lambda border: border <= place)
    return series.withColumn("_borders", borders).withColumn("_range", F.size(at_or_before)).drop("_borders")


def totals_before(
    series: DataFrame,
    outer: list[str],
    inner: list[str],
    sums: list[str],
    tail: str | None = None,
    tail_rows: int = 0,
    ranges: int = RANGES,
) -> DataFrame:
    """Per series, sums and the last values over all series before it in its outer segment.

    ``series`` has one row per (outer, inner) and is read several times: make it
    ``durable`` when it takes more than a scan to get. The result has these keys, a
    ``before_<name>`` for every sum (0 at the start), and ``before_<tail>``: the
    last ``tail_rows`` elements of the concatenated arrays of the earlier rows.
    """
    needed = series.select(*outer, *inner, *sums, *([tail] if tail else []))
    placed = with_range(needed, [*outer, *inner], ranges)

    def run(df: DataFrame, partition: list[str], order: list[str], prefix: str) -> DataFrame:
        along = Window.partitionBy(*partition).orderBy(*order)
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        columns = {f"{prefix}{s}": F.coalesce(F.sum(s).over(earlier), F.lit(0)) for s in sums}
        if tail:
            # Every row brings at least one element, so this many rows are enough.
            columns["_recent"] = F.flatten(F.collect_list(tail).over(along.rowsBetween(-tail_rows, -1)))
        result = df.withColumns(columns)
        if tail:
            result = result.withColumn(f"{prefix}{tail}", arrays.last(F.col("_recent"), tail_rows)).drop("_recent")
        return result

    within = run(placed, [*outer, "_range"], inner, "_in_")
    merged = {s: F.sum(s).alias(s) for s in sums}
    if tail:
        through = arrays.last(F.concat(f"_in_{tail}", tail), tail_rows)
        merged[tail] = F.max_by(through, F.struct(*inner)).alias(tail)
    per_range = run(within.groupBy(*outer, "_range").agg(*merged.values()), outer, ["_range"], "_up_to_")
    carried = per_range.select(*outer, "_range", *[f"_up_to_{name}" for name in merged])
    both = within.join(carried, [*outer, "_range"])
    result = [(F.col(f"_up_to_{s}") + F.col(f"_in_{s}")).alias(f"before_{s}") for s in sums]
    if tail:
        result.append(arrays.last(F.concat(f"_up_to_{tail}", f"_in_{tail}"), tail_rows).alias(f"before_{tail}"))
    return both.select(*outer, *inner, *result)
