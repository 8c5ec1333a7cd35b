"""The roll-up cube of actual and forecast values, and queries on it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast import KEYS, TARGET, TIME
from panelcast.functions import dates
from panelcast.functions.numeric import band_high, band_low
from panelcast.operators.ordering import totals_before
from panelcast.operators.split import in_years
from panelcast.session import durable

# Error margin of the band, month names.
ERROR_MARGIN = 0.15
MONTH_NAMES = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")
ALL = "ALL"

Span = tuple[dt.date, dt.date]


def month_name(month_no: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in MONTH_NAMES]), month_no)


def forecast_cube(
    history: DataFrame,
    forecasts: DataFrame,
    first_year: int,
    last_year: int,
    actual_until: dt.date,
    forecast_spans: list[Span],
    forecast: str = "forecast",
    keys=KEYS,
    time=TIME,
    target=TARGET,
    margin: float = ERROR_MARGIN,
) -> DataFrame:
    """Actual and forecast per (series, segment, everything) for every month of the years asked for.

    A skeleton of empty cells joins the data by union, so one pass over
    grouping sets both sums and completes the cube, and no member has to be
    joined back. Actuals are 0 where nothing happened up to ``actual_until`` and
    null later; forecasts are 0 inside the given spans and null outside. Bands
    follow from the rolled-up forecast. Members come from the history; the
    top member adds up every forecast row, known series or not.
    """
    outer, inner = keys
    past = history.filter(in_years(time, first=first_year, last=last_year))
    months = dates.month_range(F.lit(dt.date(first_year, 1, 1)), F.lit(dt.date(last_year, 12, 1)))
    nothing = F.lit(None).cast("long")
    skeleton = past.select(*keys).distinct().select(
        *keys, F.explode(months).alias(time), nothing.alias("a"), nothing.alias("p"), F.lit(1).alias("known")
    )
    actuals = past.select(*keys, time, F.col(target).cast("long").alias("a"), nothing.alias("p"), F.lit(1).alias("known"))
    predicted = forecasts.filter(in_years(time, first=first_year, last=last_year)).select(
        *keys, time, nothing.alias("a"), F.col(forecast).cast("long").alias("p"), F.lit(0).alias("known")
    )
    cells = skeleton.unionByName(actuals).unionByName(predicted)
    sums = cells.groupingSets(
        [[outer, inner, time], [outer, time], [time]], F.col(outer), F.col(inner), F.col(time)
    ).agg(
        F.grouping(outer).alias("_no_outer"),
        F.grouping(inner).alias("_no_inner"),
        F.sum("a").alias("a"),
        F.sum("p").alias("p"),
        F.max("known").alias("known"),
    )
    in_span = F.lit(False)
    for first, last in forecast_spans:
        in_span = in_span | F.col(time).between(F.lit(first), F.lit(last))
    zero = F.lit(0).cast("long")
    expected = F.when(in_span, F.greatest(F.coalesce(F.col("p"), zero), zero))
    members = sums.filter(F.col("known") == 1).select(
        F.when(F.col("_no_outer") == 1, F.lit(ALL)).otherwise(F.col(outer)).alias(outer),
        F.when(F.col("_no_inner") == 1, F.lit(ALL)).otherwise(F.col(inner)).alias(inner),
        F.year(time).alias("year"),
        F.month(time).alias("month_no"),
        month_name(F.month(time)).alias("month_name"),
        F.when(F.col(time) <= F.lit(actual_until), F.greatest(F.coalesce(F.col("a"), zero), zero)).alias("actual"),
        expected.alias("forecast"),
    )
    return members.withColumns(
        {"lo": band_low(F.col("forecast"), margin), "hi": band_high(F.col("forecast"), margin)}
    )


def cube_by_year(cube: DataFrame, keys=KEYS) -> DataFrame:
    """Yearly sums per member; a year without any value stays null, bands are sums of monthly bands."""
    return cube.groupBy(*keys, "year").agg(*[F.sum(c).alias(c) for c in ("actual", "forecast", "lo", "hi")])


def _known_unit(cube: DataFrame, district: str, unit: str, keys=KEYS) -> Column:
    """The unit asked for when the segment has it, otherwise ALL."""
    outer, inner = keys
    found = cube.filter((F.col(outer) == district) & (F.col(inner) == unit)).agg(F.max(inner).alias("u")).scalar()
    return F.coalesce(found, F.lit(ALL))


def cube_slice(
    cube: DataFrame,
    district: str = ALL,
    unit: str = ALL,
    year: int | None = None,
    month_no: int | None = None,
    keys=KEYS,
) -> DataFrame:
    """Rows (label, actual, forecast, lo, hi) of one member.

    Without a year one row per year, with a year its twelve months, with a
    month that month. An unknown unit of a segment falls back to the whole segment.
    """
    outer, inner = keys
    wanted = F.lit(ALL) if unit == ALL else _known_unit(cube, district, unit, keys)
    member = cube.filter((F.col(outer) == district) & (F.col(inner) == wanted))
    values = ("actual", "forecast", "lo", "hi")
    if year is None:
        return cube_by_year(member, keys).select(F.col("year").cast("string").alias("label"), *values)
    months = member.filter(F.col("year") == year)
    if month_no is not None:
        months = months.filter(F.col("month_no") == month_no)
    return months.select(F.col("month_name").alias("label"), *values)


def cube_totals(rows: DataFrame) -> DataFrame:
    """Totals of a slice; null when no row has a value."""
    return rows.agg(F.sum("actual").alias("actual"), F.sum("forecast").alias("forecast"))


def hierarchy(panel: DataFrame, keys=KEYS) -> DataFrame:
    """Selector list: every segment with each of its units."""
    return panel.select(*keys).distinct()


def hierarchy_documents(panel: DataFrame, keys=KEYS) -> DataFrame:
    """One row per segment with the sorted array of its units, for the JSON sink."""
    outer, inner = keys
    return hierarchy(panel, keys).groupBy(outer).agg(F.sort_array(F.collect_list(inner)).alias("units"))


def cube_split(cube: DataFrame, keys=KEYS) -> DataFrame:
    """Half of each segment in name order: 1 for the first half and the top member, 2 for the rest.

    Places are counted by ranges of names, so no task sees all segments.
    """
    outer = keys[0]
    segments = cube.filter(F.col(outer) != ALL).select(outer).distinct().withColumn("one", F.lit(1).cast("long"))
    before = totals_before(durable(segments), [], [outer], ["one"])
    half = segments.agg(F.floor(F.count(F.lit(1)) / 2).alias("half")).scalar()
    buckets = before.select(outer, F.when(F.col("before_one") < half, F.lit(1)).otherwise(F.lit(2)).alias("bucket"))
    top = cube.filter(F.col(outer) == ALL).select(outer).distinct().withColumn("bucket", F.lit(1))
    return buckets.unionByName(top)


def cube_documents(cube: DataFrame, keys=KEYS) -> DataFrame:
    """One JSON text per member: year -> month -> values, nulls written out.

    A document covers the months of one member, so its size does not grow with
    the number of units in a segment. ``bucket`` says which half it belongs to.
    """
    outer, inner = keys
    values = F.struct("actual", "forecast", "lo", "hi")
    by_year = cube.groupBy(*keys, "year").agg(
        F.sort_array(F.collect_list(F.struct("month_no", "month_name", values.alias("cell")))).alias("months")
    )
    by_member = by_year.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("year").cast("string").alias("year"), F.col("months")))).alias("years")
    )
    nested = F.map_from_entries(
        F.transform(
            "years",
            lambda y: F.struct(
                y["year"],
                F.map_from_entries(F.transform(y["months"], lambda m: F.struct(m["month_name"], m["cell"]))),
            ),
        )
    )
    text = F.to_json(nested, {"ignoreNullFields": "false"})
    return by_member.join(cube_split(cube, keys), outer).select("bucket", outer, inner, text.alias("document"))


def cube_tree(documents: DataFrame, keys=KEYS) -> DataFrame:
    """The nested document of each half, segment -> unit -> year -> month, in ordered fragments.

    ``documents`` come from :func:`cube_documents`. A fragment is one member's document with the brackets, names
    and commas that stand before and after it, so the fragments of a half, in order of segment and unit, spell
    one JSON object, and no row grows with a segment. First and last members come from two small aggregates.
    """
    outer, inner = keys
    spans = documents.groupBy("bucket", outer).agg(F.min(inner).alias("first_unit"), F.max(inner).alias("last_unit"))
    halves = spans.groupBy("bucket").agg(F.min(outer).alias("first_segment"), F.max(outer).alias("last_segment"))
    rows = documents.join(spans, ["bucket", outer]).join(halves, "bucket")

    def name(column: str) -> Column:
        """The name as a JSON string."""
        return F.regexp_replace(F.to_json(F.array(column)), r"^\[|\]$", "")

    opens, closes = F.col(inner) == F.col("first_unit"), F.col(inner) == F.col("last_unit")
    starts = opens & (F.col(outer) == F.col("first_segment"))
    ends = closes & (F.col(outer) == F.col("last_segment"))
    fragment = F.concat(
        F.when(starts, "{").otherwise(","),
        F.when(opens, F.concat(name(outer), F.lit(":{"))).otherwise(""),
        name(inner),
        F.lit(":"),
        "document",
        F.when(closes, "}").otherwise(""),
        F.when(ends, "}").otherwise(""),
    )
    return rows.select("bucket", outer, inner, fragment.alias("fragment"))
