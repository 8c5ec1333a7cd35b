"""From records to a dense monthly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast import AREA, KEYS, TARGET, TIME
from panelcast.functions import dates

# Copies of the small side in a salted join: a hot key is spread over this many tasks.
SALTS = 16


def _most_frequent(value: str, count: str) -> Column:
    """The value with the highest count, the smallest on ties; null values do not compete."""
    order = F.when(F.col(value).isNotNull(), F.struct(-F.col(count), F.col(value)))
    return F.min_by(value, order)


def group_mode(df: DataFrame, by: list[str], value: str, default: str, name: str) -> DataFrame:
    """Statistical mode of ``value`` per group.

    Counting (group, value) pairs first reduces the rows by hash aggregation
    before anything is ordered, and splits a hot group by its values.
    """
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*by).agg(F.coalesce(_most_frequent(value, "_n"), F.lit(default)).alias(name))


def monthly_counts(
    records: DataFrame,
    keys: tuple[str, ...] = KEYS,
    date: str = "received_at",
    case_id: str = "case_id",
    area: str = "area",
    default_area: str = "N/A",
) -> DataFrame:
    """Records to one row per series and month: count of cases and the mode of their area.

    The raw rows meet a single hash aggregation by (series, month, area); a
    series that holds a third of all rows is reduced map-side before it moves.
    The reduced rows are then laid out by series, and that layout serves every
    later step that works per series.
    """
    usable = records.dropna(subset=[*keys, date])
    by_area = (
        usable.withColumn(TIME, dates.month_of(F.col(date)))
        .groupBy(*keys, TIME, area)
        .agg(F.count(case_id).alias("_cases"), F.count(F.lit(1)).alias("_n"))
        .repartition(*keys)
    )
    return by_area.groupBy(*keys, TIME).agg(
        F.sum("_cases").alias(TARGET),
        F.coalesce(_most_frequent(area, "_n"), F.lit(default_area)).alias(AREA),
    )


def observed_months(panel: DataFrame, time: str = TIME) -> Column:
    """Sorted array of the months present, as a scalar subquery (one short row)."""
    return panel.agg(F.sort_array(F.collect_set(time)).alias("months")).scalar()


def calendar_months(panel: DataFrame, time: str = TIME) -> Column:
    """All months from the first to the last present, gaps included."""
    return panel.agg(dates.month_range(F.min(time), F.max(time)).alias("months")).scalar()


def salted_left_join(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: str, salts: int = SALTS
) -> DataFrame:
    """Left join on keys that may be hot: the left side is spread over ``salts`` copies of the right."""
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = F.array(*[F.lit(i) for i in range(salts)])
    salted_right = right.withColumn("_salt", F.explode(copies))
    return salted_left.join(salted_right, [*on, "_salt"], "left").drop("_salt")


def past_modes(
    monthly: DataFrame,
    months: Column,
    keys: tuple[str, ...] = KEYS,
    time: str = TIME,
    into: str = "_area_past",
) -> DataFrame:
    """The mode of the area over an inner segment's cells of earlier months, for every month it is asked for.

    One row per (inner, month) that has an earlier cell with an area; ties go to the smaller name. Cells are counted per
    (inner, area, month) first, so a segment with any number of series is as many rows as it has areas and months.
    """
    inner = keys[-1]
    known = monthly.filter(F.col(AREA).isNotNull())
    counted = known.groupBy(inner, AREA, time).agg(F.count(F.lit(1)).alias("_n"))
    cells = counted.groupBy(inner, AREA).agg(F.map_from_entries(F.collect_list(F.struct(time, "_n"))).alias("_cells"))
    dense = cells.select(inner, AREA, "_cells", F.explode(months).alias(time))
    earlier = Window.partitionBy(inner, AREA).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum(F.coalesce(F.try_element_at("_cells", F.col(time)), F.lit(0))).over(earlier)
    running = dense.select(inner, AREA, time, before.alias("_before")).filter(F.col("_before") > 0)
    return running.groupBy(inner, time).agg(F.min_by(AREA, F.struct(-F.col("_before"), F.col(AREA))).alias(into))


def zero_fill(
    monthly: DataFrame,
    keys: tuple[str, ...] = KEYS,
    time: str = TIME,
    target: str = TARGET,
    grid: str = "observed",
    fill_area: bool = True,
    default_area: str = "Cível",
    area: str = "same",
) -> DataFrame:
    """Every series gets every month; absent cells count zero.

    The grid is not a cross join: each series' cells are gathered into one map
    (bounded by the number of months), and exploding the array of months
    restores the rows, so the layout by series is kept and nothing is shuffled
    again. ``grid='observed'`` uses the months seen anywhere, ``'calendar'``
    also the months nobody reported.

    Absent cells take the mode of the area over the *inner* segment, not the
    series (``fill_area``). That mode is over the whole history, and other cells have the area of their own
    month. With ``area='past'`` every cell takes the mode over the inner segment's earlier months instead
    (:func:`past_modes`), ``default_area`` where there are none, so nothing of its own or a later month is used.
    """
    if area not in ("same", "past"):
        raise ValueError(f"area is 'same' or 'past', not {area!r}")
    months = observed_months(monthly, time) if grid == "observed" else calendar_months(monthly, time)
    has_area = AREA in monthly.columns
    cell = F.struct(F.col(target), F.col(AREA) if has_area else F.lit(None).cast("string").alias(AREA))
    series = monthly.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(time), cell))).alias("_cells")
    )
    inner = keys[-1]
    fill_with = F.lit(None).cast("string")
    if has_area and fill_area and area == "same":
        modes = group_mode(monthly, [inner], AREA, default_area, "_area_fill")
        series = salted_left_join(series, modes, [inner], keys[0])
        fill_with = F.col("_area_fill")
    dense = series.select(*keys, "_cells", fill_with.alias("_area_fill"), F.explode(months).alias(time))
    found = F.try_element_at("_cells", F.col(time))
    columns = [
        *[F.col(k) for k in keys],
        F.col(time),
        F.coalesce(found[target], F.lit(0)).cast("long").alias(target),
    ]
    if not has_area:
        return dense.select(*columns)
    if area == "past":
        modes = past_modes(monthly, months, keys, time)
        filled = salted_left_join(dense.select(*columns), modes, [inner, time], keys[0])
        return filled.select(*keys, time, target, F.coalesce("_area_past", F.lit(default_area)).alias(AREA))
    columns.append(F.coalesce(found[AREA], F.col("_area_fill")).alias(AREA))
    return dense.select(*columns)


def series_list(panel: DataFrame, keys: tuple[str, ...] = KEYS, default_area: str = "Cível") -> DataFrame:
    """The series to forecast: one row per pair, with the mode of its monthly areas."""
    return group_mode(panel, list(keys), AREA, default_area, AREA)


def series_with_areas(panel: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The older universe: a series appears once for every area it ever had."""
    return panel.select(*keys, AREA).distinct()


def dedup_panel(
    panel: DataFrame,
    keys: tuple[str, ...] = KEYS,
    time: str = TIME,
    order: Column | None = None,
) -> DataFrame:
    """First row per (month, series) in an explicit order, by default that of the other columns.

    An aggregate rather than a ranking window: copies of one cell are reduced
    map-side and never sorted together in one task.
    """
    rest = [c for c in panel.columns if c not in (*keys, time)]
    row = F.struct(*rest)
    kept = panel.groupBy(*keys, time).agg(F.min_by(row, row if order is None else order).alias("_first"))
    return kept.select(*keys, time, *[F.col(f"_first.{c}").alias(c) for c in rest])


def tail(panel: DataFrame, rows: int = 24, keys: tuple[str, ...] = KEYS, time: str = TIME) -> DataFrame:
    """The last ``rows`` rows of every series."""
    newest = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return panel.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= rows).drop("_age")


def sparsity(monthly: DataFrame, dense: DataFrame, keys: tuple[str, ...] = KEYS, time: str = TIME, target: str = TARGET) -> DataFrame:
    """How sparse the panel was: months, series, grid size, imputed cells, zero cells.

    Both zero counts of the reports are given: cells that had to be imputed,
    and cells whose count is zero.
    """
    before = monthly.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_series = dense.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col(target) == 0).alias("zeros"),
        F.min(time).alias("first"),
        F.max(time).alias("last"),
    )
    sums = per_series.agg(
        F.max("cells").alias("months"),
        F.count(F.lit(1)).alias("series"),
        F.sum("cells").alias("grid_cells"),
        F.sum("zeros").alias("zero_cells"),
        F.min("first").alias("first_month"),
        F.max("last").alias("last_month"),
    )
    imputed = F.col("grid_cells") - before
    return sums.select(
        "months",
        "series",
        "grid_cells",
        imputed.alias("imputed_cells"),
        (imputed / F.col("grid_cells") * 100.0).alias("imputed_pct"),
        "zero_cells",
        (F.col("zero_cells") / F.col("grid_cells") * 100.0).alias("zero_pct"),
        "first_month",
        "last_month",
    )
