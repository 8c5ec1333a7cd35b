"""The catalogue: every query by name, with the SQL that states its result.

All queries read whole tables. Months are shown as ``YYYY-MM``, fractional
numbers are rounded on both sides because the last bits of a sum depend on the
order of its parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import dates, text
from panelcast.models import blend, forecast, ridge, trees
from panelcast.operators import cube, extended, features, panel, profile, reports, split, state
from panelcast.plans import sql as q
from panelcast.plans import stages
from panelcast.plans.stages import ORDERS
from panelcast.sources import records, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TRIG_DIGITS = 9


def show(df: DataFrame, digits: int = 6) -> DataFrame:
    """Months as text, doubles rounded."""
    shown = []
    for name, dtype in df.dtypes:
        column = F.col(name)
        if dtype == "date":
            column = dates.month_label(column)
        elif dtype == "double":
            column = F.round(column, digits)
        shown.append(column.alias(name))
    return df.select(*shown)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


# --- sources --------------------------------------------------------------

_TEXT_DATE = "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')"


def _short_text(column: str) -> F.Column:
    return F.date_format(F.col(column).cast("date"), "d/M/yy")


@query("parse_dates", f"SELECT o_orderkey AS case_id, {_TEXT_DATE} AS received_at FROM orders")
def parse_dates(spark, sf):
    orders = tables.table(spark, sf, "orders")
    parsed = dates.parse_short_date(_short_text("o_orderdate"))
    return orders.select(F.col("o_orderkey").alias("case_id"), parsed.cast("string").alias("received_at"))


@query(
    "ingest_union",
    f"""SELECT o_orderkey::VARCHAR AS case_id, {_TEXT_DATE} AS received_at, c_mktsegment AS unit, n_name AS district,
               o_orderpriority AS priority, o_orderstatus AS area,
               CASE WHEN year(o_orderdate) >= 2000 THEN 'N/A' ELSE o_orderstatus END AS status,
               CASE WHEN year(o_orderdate) >= 2000 THEN NULL ELSE round(o_totalprice, 6) END AS value
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def ingest_union(spark, sf):
    """Orders laid out as the three file layouts by year, read back through their normalisers and united."""
    orders = tables.table(spark, sf, "orders")
    customers = tables.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = tables.table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations, F.col("c_nationkey") == nations.n_nationkey
    )
    source = {
        "NUMERO": F.col("o_orderkey").cast("string"),
        "DATA_RECEBIMENTO": _short_text("o_orderdate"),
        "PRIORIDADE": F.col("o_orderpriority"),
        "SEGREDO_JUSTICA": F.lit("N"),
        "SERVENTIA": F.col("c_mktsegment"),
        "COMARCA": F.col("n_name"),
        "CLASSE": F.col("o_orderstatus"),
        "ASSUNTOS": F.col("o_orderpriority"),
        "PROC_STATUS": F.col("o_orderstatus"),
        "AREA": F.col("o_orderstatus"),
        "AREA_ACAO": F.col("o_orderstatus"),
        "VALOR_CAUSA": F.col("o_totalprice").cast("string"),
    }
    new_names = {old: new for new, old in records.RENAMED_COLUMNS.items()}

    def layout(first: int | None, last: int | None, rename: bool, extra: bool) -> DataFrame:
        rows = joined.filter(split.in_years("o_orderdate", first, last))
        columns = [c.alias(new_names.get(name, name) if rename else name) for name, c in source.items()]
        return rows.select(*columns, *([F.lit("").alias(records.LEGACY_EXTRA)] if extra else []))

    united = (
        records.legacy_record(layout(None, 1996, False, True))
        .unionByName(records.to_record(layout(1997, 1999, False, False)))
        .unionByName(records.renamed_record(layout(2000, None, True, False)))
    )
    return united.select(
        "case_id",
        F.col("received_at").cast("string").alias("received_at"),
        "unit",
        "district",
        "priority",
        "area",
        "status",
        F.round("value", 6).alias("value"),
    )


@query(
    "clean_keys",
    """SELECT o_orderkey AS case_id, upper(trim(d)) AS district, trim(u) AS unit FROM (
         SELECT o_orderkey, CASE WHEN n_nationkey = 7 THEN NULL ELSE '  ' || lower(n_name) || chr(9) END AS d,
                chr(9) || c_mktsegment || chr(10) AS u
         FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
       WHERE d IS NOT NULL""".replace("trim(d)", "trim(d, ' ' || chr(9) || chr(10))").replace(
        "trim(u)", "trim(u, ' ' || chr(9) || chr(10))"
    ),
)
def clean_keys(spark, sf):
    """Keys padded with blanks, tabs and line ends, one of them missing, are cleaned again."""
    orders = tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customers = tables.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = tables.table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations, F.col("c_nationkey") == nations.n_nationkey
    )
    padded = joined.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("n_nationkey") != 7, F.concat(F.lit("  "), F.lower("n_name"), F.lit("\t"))).alias("district"),
        F.concat(F.lit("\t"), F.col("c_mktsegment"), F.lit("\n")).alias("unit"),
    )
    return records.clean_keys(padded)


@query(
    "coerce_numeric",
    """SELECT event_id, CAST(k AS DOUBLE) AS k, round(value, 6) AS value FROM (
         SELECT event_id, value, TRY_CAST(
                  CASE WHEN event_type = 'error' THEN 'n/a' ELSE regexp_extract(props, '([0-9]+)', 1) END AS INTEGER) AS k
         FROM events) WHERE k IS NOT NULL AND value IS NOT NULL""",
)
def coerce_numeric(spark, sf):
    """Numbers arriving as text, some unreadable."""
    events = tables.table(spark, sf, "events")
    text = events.select(
        "event_id",
        F.when(F.col("event_type") == "error", F.lit("n/a"))
        .otherwise(F.regexp_extract("props", "([0-9]+)", 1))
        .alias("k"),
        F.col("value").cast("string").alias("value"),
    )
    numbers = records.coerce_numeric(text, ["k", "value"])
    return numbers.select("event_id", "k", F.round("value", 6).alias("value"))


# --- profiling ------------------------------------------------------------


def _overview_sql(name: str, columns: list[tuple[str, str]]) -> str:
    parts = [
        f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS type, count(*) - count({c}) AS nulls,
                   {q.even(f"(count(*) - count({c})) / CAST(count(*) AS DOUBLE) * 100e0", 2)} AS nulls_pct,
                   count(DISTINCT {c}) AS distinct_values FROM {name}"""
        for i, (c, t) in enumerate(columns)
    ]
    return " UNION ALL ".join(parts)


_ORDER_COLUMNS = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "bigint"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"),
    ("o_orderpriority", "string"),
]


@query("profile_columns", _overview_sql("orders", _ORDER_COLUMNS))
def profile_columns(spark, sf):
    return profile.column_overview(tables.table(spark, sf, "orders"))


_CLOSE = 0.05


@query(
    "profile_sketches",
    f"""SELECT position, "column", type, nulls, nulls_pct, TRUE AS close
        FROM ({_overview_sql("orders", _ORDER_COLUMNS)})""",
)
def profile_sketches(spark, sf):
    """Distinct values of all columns from sketches per year, united; held against the exact numbers within 5 % (three errors)."""
    orders = tables.table(spark, sf, "orders")
    sketches = profile.column_sketches(orders.withColumn("year", F.year("o_orderdate")), ["year"])
    found = profile.sketched_overview(stages.durable(sketches))
    exact = profile.column_overview(orders).select("column", F.col("distinct_values").alias("exact"))
    close = F.abs(F.col("distinct_values") - F.col("exact")) <= _CLOSE * F.col("exact")
    return found.join(exact, "column").select("position", "column", "type", "nulls", "nulls_pct", close.alias("close"))


@query(
    "eda_summary",
    f"""WITH {q.RECORDS} SELECT count(*) AS records, CAST(min(received_at) AS VARCHAR) AS first_date,
        CAST(max(received_at) AS VARCHAR) AS last_date, count(DISTINCT district) AS districts,
        count(DISTINCT unit) AS units, count(DISTINCT area) AS areas,
        {q.even("(count(*) - count(value)) / CAST(count(*) AS DOUBLE) * 100e0", 2)} AS value_nulls_pct FROM rec""",
)
def eda_summary(spark, sf):
    row = profile.summary(tables.order_records(spark, sf))
    return row.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@query(
    "yearly_cardinality",
    f"""WITH {q.RECORDS} SELECT CAST(year(received_at) AS INTEGER) AS year, count(*) AS cases,
        count(DISTINCT district) AS districts, count(DISTINCT unit) AS units, count(DISTINCT area) AS areas
        FROM rec GROUP BY 1""",
)
def yearly_cardinality(spark, sf):
    return profile.yearly_cardinality(tables.order_records(spark, sf))


def _share_sql(column: str, limit: int | None = None) -> str:
    top = f" ORDER BY cases DESC, {column} LIMIT {limit}" if limit else ""
    return f"""WITH {q.RECORDS} SELECT {column}, count(*) AS cases,
        {q.even("count(*) / CAST((SELECT count(*) FROM rec) AS DOUBLE) * 100e0", 2)} AS share_pct
        FROM rec WHERE {column} IS NOT NULL GROUP BY {column}{top}"""


@query("top_districts", _share_sql("district", 15))
def top_districts(spark, sf):
    return profile.top_values(tables.order_records(spark, sf), "district")


@query("top_units", _share_sql("unit", 15))
def top_units(spark, sf):
    return profile.top_values(tables.order_records(spark, sf), "unit")


@query("area_distribution", _share_sql("area"))
def area_distribution(spark, sf):
    return profile.value_counts(tables.order_records(spark, sf), "area")


@query(
    "monthly_volume",
    f"WITH {q.RECORDS} SELECT strftime(received_at, '%Y-%m') AS month, count(*) AS cases FROM rec GROUP BY 1",
)
def monthly_volume(spark, sf):
    return profile.monthly_volume(tables.order_records(spark, sf))


@query(
    "yearly_volume",
    f"WITH {q.RECORDS} SELECT CAST(year(received_at) AS INTEGER) AS year, count(*) AS cases FROM rec GROUP BY 1",
)
def yearly_volume(spark, sf):
    return profile.yearly_volume(tables.order_records(spark, sf))


_HEAT = ", ".join(f"count(*) FILTER (month(received_at) = {m}) AS m{m:02d}" for m in range(1, 13))


@query(
    "heatmap_pivot",
    f"WITH {q.RECORDS} SELECT CAST(year(received_at) AS INTEGER) AS year, {_HEAT} FROM rec GROUP BY 1",
)
def heatmap_pivot(spark, sf):
    return profile.heatmap(tables.order_records(spark, sf))


@query(
    "district_month_quartiles",
    f"""WITH {q.RECORDS},
        top AS (SELECT district FROM rec GROUP BY district ORDER BY count(*) DESC, district LIMIT 10),
        n AS (SELECT district, date_trunc('month', received_at) AS month, CAST(count(*) AS DOUBLE) AS cases
              FROM rec SEMI JOIN top USING (district) GROUP BY ALL)
        SELECT district, min(cases) AS minimum, quantile_cont(cases, 0.25) AS q25, quantile_cont(cases, 0.5) AS median,
               quantile_cont(cases, 0.75) AS q75, max(cases) AS maximum FROM n GROUP BY district""",
)
def district_month_quartiles(spark, sf):
    return profile.district_month_quartiles(tables.order_records(spark, sf))


# --- panel ----------------------------------------------------------------


@query("monthly_counts", f"WITH {q.SPARSE} SELECT district, unit, {q.MONTH}, y FROM cnt")
def monthly_counts(spark, sf):
    return show(panel.monthly_counts(tables.order_records(spark, sf)).drop("area_mode"))


@query("area_mode", f"WITH {q.SPARSE} SELECT district, unit, {q.MONTH}, area_mode FROM cnt")
def area_mode(spark, sf):
    return show(panel.monthly_counts(tables.order_records(spark, sf)).drop("y"))


@query("zero_fill", f"WITH {q.DENSE} SELECT district, unit, {q.MONTH}, y FROM dense")
def zero_fill(spark, sf):
    return show(stages.dense_panel(spark, sf).drop("area_mode"))


@query("zero_fill_area", f"WITH {q.DENSE} SELECT district, unit, {q.MONTH}, y, area_mode FROM dense")
def zero_fill_area(spark, sf):
    return show(stages.dense_panel(spark, sf))


@query(
    "zero_fill_area_past",
    f"""WITH {q.DENSE}, cells AS (SELECT unit, month, area_mode, count(*) AS n FROM cnt GROUP BY ALL),
        past AS (SELECT m.month, c.unit, c.area_mode, sum(c.n) AS n FROM months m JOIN cells c ON c.month < m.month GROUP BY ALL),
        best AS (SELECT unit, month, first(area_mode ORDER BY n DESC, area_mode) AS area FROM past GROUP BY unit, month)
        SELECT d.district, d.unit, {q.MONTH.replace("month,", "d.month,")}, d.y, coalesce(b.area, 'Cível') AS area_mode
        FROM dense d LEFT JOIN best b ON b.unit = d.unit AND b.month = d.month""",
)
def zero_fill_area_past(spark, sf):
    """A cell's area is the mode over the unit's earlier months: nothing of its own month or a later one."""
    return show(panel.zero_fill(stages.durable(stages.sparse_panel(spark, sf)), area="past"))


@query(
    "zero_fill_calendar",
    f"""WITH {q.SPARSE},
        cal AS (SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM cnt),
        ser AS (SELECT DISTINCT district, unit FROM cnt)
        SELECT district, unit, {q.MONTH}, CAST(coalesce(y, 0) AS BIGINT) AS y
        FROM cal CROSS JOIN ser LEFT JOIN cnt USING (district, unit, month)""",
)
def zero_fill_calendar(spark, sf):
    """The grid follows the calendar, so months without any record are completed too."""
    sparse = stages.durable(panel.monthly_counts(tables.order_records(spark, sf)).drop("area_mode"))
    return show(panel.zero_fill(sparse, grid="calendar"))


@query(
    "sparsity_stats",
    f"""WITH {q.DENSE} SELECT (SELECT count(*) FROM months) AS months, (SELECT count(*) FROM series) AS series,
        count(*) AS grid_cells, count(*) - (SELECT count(*) FROM cnt) AS imputed_cells,
        {q.rnd("(count(*) - (SELECT count(*) FROM cnt)) / CAST(count(*) AS DOUBLE) * 100e0")} AS imputed_pct,
        count(*) FILTER (y = 0) AS zero_cells,
        {q.rnd("count(*) FILTER (y = 0) / CAST(count(*) AS DOUBLE) * 100e0")} AS zero_pct,
        strftime(min(month), '%Y-%m') AS first_month, strftime(max(month), '%Y-%m') AS last_month FROM dense""",
)
def sparsity_stats(spark, sf):
    sparse = stages.sparse_panel(spark, sf)
    return show(panel.sparsity(sparse, panel.zero_fill(sparse)))


@query(
    "series_list",
    f"""WITH {q.DENSE} SELECT district, unit, first(area_mode ORDER BY n DESC, area_mode) AS area_mode
        FROM (SELECT district, unit, area_mode, count(*) AS n FROM dense GROUP BY ALL) GROUP BY district, unit""",
)
def series_list(spark, sf):
    return panel.series_list(stages.dense_panel(spark, sf))


@query("series_with_areas", f"WITH {q.DENSE} SELECT DISTINCT district, unit, area_mode FROM dense")
def series_with_areas(spark, sf):
    return panel.series_with_areas(stages.dense_panel(spark, sf))


@query(
    "dedup_panel",
    f"WITH {q.DENSE} SELECT district, unit, {q.MONTH}, min(y) AS y FROM "
    "(SELECT * FROM dense UNION ALL SELECT district, unit, month, y + 5, area_mode FROM dense) GROUP BY ALL",
)
def dedup_panel(spark, sf):
    """Every cell twice, the copy with a larger count; the smaller one is kept."""
    dense = stages.dense_panel(spark, sf).drop("area_mode")
    copies = dense.unionByName(dense.withColumn("y", F.col("y") + 5))
    return show(panel.dedup_panel(copies))


@query(
    "tail_24",
    f"""WITH {q.DENSE} SELECT district, unit, {q.MONTH}, y FROM dense
        QUALIFY row_number() OVER (PARTITION BY district, unit ORDER BY month DESC) <= 24""",
)
def tail_24(spark, sf):
    return show(panel.tail(stages.dense_panel(spark, sf).drop("area_mode"), 24))


# --- features -------------------------------------------------------------

_KEYS = f"district, unit, {q.MONTH}"


def _rounded(names: dict[str, str], digits: int = 6, exact: tuple[str, ...] = ()) -> str:
    return ", ".join(name if name in exact else f"{q.rnd(name, digits)} AS {name}" for name in names)


def _feature_sql(names: dict[str, str], digits: int = 6, exact: tuple[str, ...] = ()) -> str:
    return f"""WITH {q.DENSE}, f AS (SELECT district, unit, month, {q.columns(names)} FROM dense)
        SELECT {_KEYS}, {_rounded(names, digits, exact)} FROM f"""


def _features(df: DataFrame, digits: int = 6) -> DataFrame:
    return show(df.drop("y", "area_mode"), digits)


@query("feat_lags", _feature_sql(q.LAG_SQL, exact=tuple(q.LAG_SQL)))
def feat_lags(spark, sf):
    return _features(features.add_lags(stages.dense_panel(spark, sf)))


@query("feat_rolling", _feature_sql(q.ROLLING_SQL))
def feat_rolling(spark, sf):
    return _features(features.add_rolling(stages.dense_panel(spark, sf)))


_CALENDAR = {**q.CALENDAR_SQL, **q.AREA_SQL}


@query(
    "calendar_features",
    _feature_sql(_CALENDAR, TRIG_DIGITS, tuple(c for c in _CALENDAR if c not in ("month_sin", "month_cos"))),
)
def calendar_features(spark, sf):
    dense = stages.dense_panel(spark, sf)
    added = features.add_calendar(dense, rules=ORDERS.rules).withColumns(features.area_features(ORDERS.rules))
    return _features(added, TRIG_DIGITS)


_INDEX = f"((year(month) - {ORDERS.epoch_year}) * 12 + month(month) - 1)"
_FOURIER_SQL = {
    f"fourier_{p}m_{f}_{k}": f"{f}({q.num(2.0 * q.math.pi * k)} * {_INDEX} / {q.num(p)})"
    for p in extended.FOURIER_PERIODS
    for k in extended.FOURIER_ORDERS
    for f in ("sin", "cos")
}


@query("feat_fourier", _feature_sql(_FOURIER_SQL, TRIG_DIGITS))
def feat_fourier(spark, sf):
    added = extended.add_fourier_features(stages.dense_panel(spark, sf), epoch_year=ORDERS.epoch_year)
    return _features(added, TRIG_DIGITS)


_QUANTILE_SQL = {}
for _w in features.WINDOWS:
    for _p in (25, 50, 75):
        _QUANTILE_SQL[f"rolling_q{_p}_{_w}"] = f"quantile_cont(CAST(y AS DOUBLE), {_p / 100}) {q.past(_w)}"
    _QUANTILE_SQL[f"rolling_iqr_{_w}"] = (
        f"coalesce({_QUANTILE_SQL[f'rolling_q75_{_w}']} - {_QUANTILE_SQL[f'rolling_q25_{_w}']}, 0)"
    )


@query("feat_quantiles", _feature_sql(_QUANTILE_SQL))
def feat_quantiles(spark, sf):
    return _features(extended.add_quantile_features(stages.dense_panel(spark, sf)))


_TREND_SQL = {}
for _w in features.WINDOWS:
    _TREND_SQL[f"trend_{_w}"] = f"avg(y) {q.past(_w)}"
    _TREND_SQL[f"detrended_{_w}"] = f"{q.lag(1)} - avg(y) {q.past(_w)}"
    _TREND_SQL[f"deviation_{_w}"] = f"abs({q.lag(1)} - avg(y) {q.past(_w)})"


@query("feat_detrended", _feature_sql(_TREND_SQL))
def feat_detrended(spark, sf):
    return _features(extended.add_detrended_features(stages.dense_panel(spark, sf)))


_HOLT = f"""o AS (
  SELECT district, unit, month, CAST(y AS DOUBLE) AS y, CAST(lag(y) OVER ({q.SERIES}) AS DOUBLE) AS before,
         row_number() OVER ({q.SERIES}) AS t FROM dense),
holt AS (
  SELECT district, unit, month, t, 0e0 AS holt_level, 0e0 AS holt_slope FROM o WHERE t = 1
  UNION ALL
  SELECT o.district, o.unit, o.month, o.t,
         CASE WHEN o.t = 2 THEN o.before ELSE 0.3e0 * o.before + 0.7e0 * (h.holt_level + h.holt_slope) END,
         CASE WHEN o.t = 2 THEN o.y - o.before
              ELSE 0.1e0 * (0.3e0 * o.before + 0.7e0 * (h.holt_level + h.holt_slope) - h.holt_level)
                   + 0.9e0 * h.holt_slope END
  FROM holt h JOIN o ON o.district = h.district AND o.unit = h.unit AND o.t = h.t + 1)"""


@query(
    "feat_holt",
    f"""WITH RECURSIVE {q.DENSE}, {_HOLT}
        SELECT {_KEYS}, {q.rnd("holt_level")} AS holt_level, {q.rnd("holt_slope")} AS holt_slope FROM holt""",
)
def feat_holt(spark, sf):
    return _features(extended.add_local_level_slope(stages.dense_panel(spark, sf)))


_SAME = "OVER (PARTITION BY district, unit, month(month) ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SEASON = f"coalesce(avg(y) {_SAME} / (avg(y) {q.ALL_PAST} + 1e-6), 1e0)"
_SEASONAL_SQL = {"seasonal_index": _SEASON, "seasonal_index_log": f"ln({_SEASON} + 1e-6)"}


@query("feat_seasonal", _feature_sql(_SEASONAL_SQL))
def feat_seasonal(spark, sf):
    return _features(extended.add_seasonal_indices(stages.dense_panel(spark, sf)))


_VOLATILITY_SQL = {f"rolling_std_3_lag_{k}": f"lag(s, {k}) OVER ({q.SERIES})" for k in extended.STD_LAGS}
_VOLATILITY_SQL["volatility_accel"] = f"coalesce(s - lag(s, 1) OVER ({q.SERIES}), 0)"


@query(
    "feat_volatility",
    f"""WITH {q.DENSE}, v AS (SELECT *, stddev_samp(y) {q.past(3)} AS s FROM dense),
        f AS (SELECT district, unit, month, {q.columns(_VOLATILITY_SQL)} FROM v)
        SELECT {_KEYS}, {_rounded(_VOLATILITY_SQL)} FROM f""",
)
def feat_volatility(spark, sf):
    return _features(extended.add_volatility_dynamics(stages.dense_panel(spark, sf)))


@query(
    "feat_volatility_ungrouped",
    f"""WITH {q.FEATURES}, f AS (
          SELECT district, unit, month,
                 coalesce(rolling_std_3 - lag(rolling_std_3) OVER (ORDER BY district, unit, month), 0) AS volatility_accel
          FROM clean)
        SELECT {_KEYS}, {q.rnd("volatility_accel")} AS volatility_accel FROM f""",
)
def feat_volatility_ungrouped(spark, sf):
    """The ungrouped difference, on a panel whose warm-up rows are gone."""
    clean = split.drop_warmup(stages.base_table(spark, sf)).select("district", "unit", "month", "y", "rolling_std_3")
    added = extended.add_volatility_dynamics(clean, cross_series_first_row=True)
    return show(added.select("district", "unit", "month", "volatility_accel"))


_CHANGE_SQL = {}
for _n in extended.CHANGE_PERIODS:
    _CHANGE_SQL[f"roc_{_n}"] = f"{q.lag(1)} - {q.lag(1 + _n)}"
    _CHANGE_SQL[f"roc_pct_{_n}"] = f"coalesce(({q.lag(1)} - {q.lag(1 + _n)}) / ({q.lag(1 + _n)} + 1e-6) * 100e0, 0)"


@query("feat_roc", _feature_sql(_CHANGE_SQL, exact=tuple(f"roc_{n}" for n in extended.CHANGE_PERIODS)))
def feat_roc(spark, sf):
    return _features(extended.add_rate_of_change_features(stages.dense_panel(spark, sf)))


_OUTER = "PARTITION BY district ORDER BY unit, month"
_INNER = "PARTITION BY unit ORDER BY district, month"
_ALL_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_DISTRICT_MEAN = f"avg(y) OVER ({_OUTER} {_ALL_BEFORE})"
_UNIT_MEAN = f"avg(y) OVER ({_INNER} {_ALL_BEFORE})"
_CROSS_SQL = {
    "district_mean": _DISTRICT_MEAN,
    "district_mean_lag": f"avg(y) OVER ({_OUTER} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)",
    "deviation_from_district": f"{q.lag(1)} - {_DISTRICT_MEAN}",
    "unit_mean": _UNIT_MEAN,
    "unit_district_ratio": f"coalesce({_UNIT_MEAN} / ({_DISTRICT_MEAN} + 1e-6), 1e0)",
}


@query("feat_cross_section", _feature_sql(_CROSS_SQL))
def feat_cross_section(spark, sf):
    return _features(extended.add_cross_sectional_features(stages.dense_panel(spark, sf)))


def _time_mean(segment: str, frame: str) -> str:
    return f"avg(y) OVER (PARTITION BY {segment} ORDER BY i RANGE BETWEEN {frame} PRECEDING AND 1 PRECEDING)"


_TIME_SQL = {
    "district_mean": _time_mean("district", "UNBOUNDED"),
    "district_mean_lag": _time_mean("district", "12"),
    "deviation_from_district": f"{q.lag(1)} - {_time_mean('district', 'UNBOUNDED')}",
    "unit_mean": _time_mean("unit", "UNBOUNDED"),
    "unit_district_ratio": f"coalesce({_time_mean('unit', 'UNBOUNDED')} / ({_time_mean('district', 'UNBOUNDED')} + 1e-6), 1e0)",
}


@query(
    "feat_cross_section_time",
    f"""WITH {q.DENSE}, i AS (SELECT *, year(month) * 12 + month(month) AS i FROM dense),
        f AS (SELECT district, unit, month, {q.columns(_TIME_SQL)} FROM i) SELECT {_KEYS}, {_rounded(_TIME_SQL)} FROM f""",
)
def feat_cross_section_time(spark, sf):
    return _features(extended.add_cross_sectional_features(stages.dense_panel(spark, sf), order="time"))


_ANOMALY = f"""CAST(coalesce(abs(({q.lag(1)} - avg(y) {q.past(12)}) / (stddev_samp(y) {q.past(12)} + 1e-6)) > 2.5e0,
    false) AS INTEGER)"""
_RECENT = f"CAST(sum(is_anomaly) OVER ({q.SERIES} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT)"


@query(
    "feat_anomaly",
    f"""WITH {q.DENSE}, f AS (SELECT *, {_ANOMALY} AS is_anomaly FROM dense)
        SELECT {_KEYS}, is_anomaly, {_RECENT} AS anomaly_count_6m FROM f""",
)
def feat_anomaly(spark, sf):
    return _features(extended.add_anomaly_features(stages.dense_panel(spark, sf)))


_WINDOWED = {
    **q.BASE_SQL,
    **_FOURIER_SQL,
    **_QUANTILE_SQL,
    **_TREND_SQL,
    **_SEASONAL_SQL,
    **_CHANGE_SQL,
    **_CROSS_SQL,
    "is_anomaly": _ANOMALY,
}
_DERIVED = {
    **{k: v.replace("lag(s,", "lag(rolling_std_3,").replace("(s -", "(rolling_std_3 -") for k, v in _VOLATILITY_SQL.items()},
    "anomaly_count_6m": _RECENT,
}
_COUNTED = {*q.LAG_SQL, *q.AREA_SQL, *(c for c in q.CALENDAR_SQL if not c.startswith("month_")), "month_of_year"}
_COUNTED |= {"is_anomaly", "anomaly_count_6m", *(f"roc_{n}" for n in extended.CHANGE_PERIODS)}


def _filled(name: str) -> str:
    if name in _COUNTED:
        return f"coalesce({name}, 0) AS {name}"
    return f"{q.rnd(f'coalesce({name}, 0)')} AS {name}"


@query(
    "features_all",
    f"""WITH RECURSIVE {q.DENSE}, {_HOLT},
        w AS (SELECT *, {q.columns(_WINDOWED)} FROM dense),
        f AS (SELECT *, {q.columns(_DERIVED)} FROM w)
        SELECT {_KEYS}, y, area_mode, {", ".join(_filled(c) for c in [*_WINDOWED, *_DERIVED])},
               {q.rnd("holt_level")} AS holt_level, {q.rnd("holt_slope")} AS holt_slope
        FROM f JOIN holt USING (district, unit, month)""",
)
def features_all(spark, sf):
    return show(stages.full_features(stages.dense_panel(spark, sf), fill_nulls=True))


# The month to come as a row without value at the end of every series, its area the series' usual one.
_OPENED = q.DENSE.replace("dense AS (", "closed AS (") + """,
usual AS (
  SELECT district, unit, first(area_mode ORDER BY n DESC, area_mode) AS area_mode
  FROM (SELECT district, unit, area_mode, count(*) AS n FROM closed GROUP BY ALL) GROUP BY district, unit
),
dense AS (
  SELECT * FROM closed
  UNION ALL
  SELECT district, unit, CAST((SELECT max(month) FROM closed) + INTERVAL 1 MONTH AS DATE), NULL, area_mode FROM usual
)"""


@query(
    "next_month_features",
    f"""WITH RECURSIVE {_OPENED}, {_HOLT},
        w AS (SELECT *, {q.columns(_WINDOWED)} FROM dense),
        f AS (SELECT *, {q.columns(_DERIVED)} FROM w)
        SELECT {_KEYS}, area_mode, {", ".join(_filled(c) for c in [*_WINDOWED, *_DERIVED])},
               {q.rnd("coalesce(holt_level, 0)")} AS holt_level, {q.rnd("coalesce(holt_slope, 0)")} AS holt_slope
        FROM f JOIN holt USING (district, unit, month) WHERE month = (SELECT max(month) FROM dense)""",
)
def next_month_features(spark, sf):
    """All features of the month after the last, from one state row per series."""
    states = stages.durable(state.start(stages.dense_panel(spark, sf)))
    known = state.next_features(states, rules=ORDERS.rules, epoch_year=ORDERS.epoch_year)
    return show(known.drop(*state.STATE))


# --- split ----------------------------------------------------------------

_BASE_EXACT = (*q.LAG_SQL, *(c for c in _CALENDAR if c not in ("month_sin", "month_cos")))
_BASE_ROWS = f"{_KEYS}, y, area_mode, {_rounded(q.BASE_SQL, 6, _BASE_EXACT)}"


@query("split_train", f"WITH {q.FEATURES} SELECT {_BASE_ROWS} FROM train")
def split_train(spark, sf):
    return show(stages.train_rows(stages.base_table(spark, sf)))


@query("split_test", f"WITH {q.FEATURES} SELECT {_BASE_ROWS} FROM test")
def split_test(spark, sf):
    return show(stages.test_rows(stages.base_table(spark, sf)))


@query(
    "leakage_check",
    f"""WITH {q.FEATURES} SELECT strftime((SELECT max(month) FROM train), '%Y-%m') AS train_last,
        strftime((SELECT min(month) FROM test), '%Y-%m') AS test_first,
        (SELECT max(month) FROM train) < (SELECT min(month) FROM test) AS in_order""",
)
def leakage_check(spark, sf):
    clean = split.drop_warmup(stages.base_table(spark, sf))
    return show(split.leakage(clean, ORDERS.last_train_year, ORDERS.test_year))


@query(
    "prep_summary",
    f"""WITH {q.FEATURES} SELECT (SELECT count(*) FROM train) AS train_rows, (SELECT count(*) FROM test) AS test_rows,
        (SELECT count(*) FROM feat) - (SELECT count(*) FROM clean) AS dropped_rows,
        (SELECT CAST(year(min(month)) AS INTEGER) FROM train) AS train_first_year,
        (SELECT count(DISTINCT month) FROM train) AS train_months,
        (SELECT count(DISTINCT month) FROM test) AS test_months""",
)
def prep_summary(spark, sf):
    return split.split_summary(stages.base_table(spark, sf), ORDERS.last_train_year, ORDERS.test_year)


# --- models ---------------------------------------------------------------


@query("model_m0", f"WITH {q.HOLDOUT} SELECT {_KEYS}, y, {q.rnd('m0')} AS m0 FROM hold")
def model_m0(spark, sf):
    return show(stages.holdout(spark, sf).select("district", "unit", "month", "y", "m0"))


@query("ridge_predict", f"WITH {q.HOLDOUT} SELECT {_KEYS}, y, {q.rnd('m1')} AS m1 FROM hold")
def ridge_predict(spark, sf):
    return show(stages.holdout(spark, sf).select("district", "unit", "month", "y", "m1"))


@query("model_m2", f"WITH {q.HOLDOUT} SELECT {_KEYS}, y, {q.rnd('m2')} AS m2 FROM hold")
def model_m2(spark, sf):
    return show(stages.holdout(spark, sf).select("district", "unit", "month", "y", "m2"))


@query(
    "feature_stats",
    f"WITH {q.FEATURES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {q.rnd(f'avg({c})')} AS mean, {q.rnd(f'stddev_pop({c})')} AS std FROM train"
        for c in features.BASE_FEATURES
    ),
)
def feature_stats(spark, sf):
    return show(ridge.feature_stats(stages.train_rows(stages.base_table(spark, sf))))


def _gram_sql() -> str:
    names = features.BASE_FEATURES
    stats = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) + 1e-8 AS std_{c}" for c in names)
    scaled = ", ".join(f"({c} - mean_{c}) / std_{c} AS z_{c}" for c in names)
    sums = ["count(*) AS g_bias_bias", "sum(y) AS g_bias_y"]
    entries = [("bias", "bias"), ("bias", "y")]
    for i, a in enumerate(names):
        sums.append(f"sum(z_{a}) AS g_bias_{a}")
        sums.append(f"sum(z_{a} * y) AS g_{a}_y")
        entries += [("bias", a), (a, "y")]
        for b in names[i:]:
            sums.append(f"sum(z_{a} * z_{b}) AS g_{a}_{b}")
            entries.append((a, b))
    rows = " UNION ALL ".join(
        f"""SELECT '{a}' AS "row", '{b}' AS col, {q.rnd(f"g_{a}_{b}")} AS value FROM g""" for a, b in entries
    )
    return f"""WITH {q.FEATURES}, stats AS (SELECT {stats} FROM train),
        z AS (SELECT y, {scaled} FROM train CROSS JOIN stats), g AS (SELECT {", ".join(sums)} FROM z) {rows}"""


@query("gram_matrix", _gram_sql())
def gram_matrix(spark, sf):
    return show(ridge.gram_matrix(stages.train_rows(stages.base_table(spark, sf))))


def _fitted(spark, sf):
    return ridge.fit_ridge(stages.train_rows(stages.base_table(spark, sf)))


@query("ridge_fit")
def ridge_fit(spark, sf):
    return show(_fitted(spark, sf).table(spark))


@query("ridge_importance")
def ridge_importance(spark, sf):
    return _fitted(spark, sf).importance(spark)


_TERMS = " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in [ridge.BIAS, *features.BASE_FEATURES])


@query("ridge_residual", f"SELECT feature, 0e0 AS residual FROM ({_TERMS})")
def ridge_residual(spark, sf):
    """What the fitted coefficients leave of the normal equations, relative to their right side: nothing."""
    train = stages.durable(stages.train_rows(stages.base_table(spark, sf)))
    gram = stages.durable(ridge.gram_matrix(train))
    beta = ridge.fit_ridge(train).table(spark).select(F.col("feature").alias("col"), "beta")
    square = gram.where("col != 'y'")
    mirrored = square.where("row != col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value")
    penalised = (F.col("row") == F.col("col")) & (F.col("row") != ridge.BIAS)
    term = (F.col("value") + F.when(penalised, F.lit(ridge.PENALTY)).otherwise(F.lit(0.0))) * F.col("beta")
    left = square.unionByName(mirrored).join(beta, "col").groupBy("row").agg(F.sum(term).alias("left"))
    right = gram.where("col = 'y'").select("row", F.col("value").alias("right"))
    residual = (F.col("left") - F.col("right")) / (F.abs("right") + F.lit(1.0))
    return left.join(right, "row").select(F.col("row").alias("feature"), F.abs(F.round(residual, 6)).alias("residual"))


_ALPHAS = ", ".join(f"({round(i * blend.GRID_STEP, 2)}e0, {q.num(i * blend.GRID_STEP)}, {q.num(1.0 - i * blend.GRID_STEP)})" for i in range(blend.GRID_STEPS + 1))
_CURVE = f"""WITH {q.HOLDOUT}, grid(alpha, a, b) AS (VALUES {_ALPHAS}),
    curve AS (SELECT alpha, {q.wmape("y", "greatest(a * m0 + b * m1, 0e0)")} AS score FROM hold CROSS JOIN grid GROUP BY alpha)"""


@query("alpha_curve", f"{_CURVE} SELECT alpha, {q.rnd('score')} AS score FROM curve")
def alpha_curve(spark, sf):
    return show(blend.alpha_curve(stages.holdout(spark, sf), "m0", "m1"))


@query(
    "tune_alpha",
    f"{_CURVE} SELECT alpha, {q.even('score', 3)} AS score FROM curve ORDER BY round(score, 9), alpha LIMIT 1",
)
def tune_alpha(spark, sf):
    return show(blend.best_alpha(blend.alpha_curve(stages.holdout(spark, sf), "m0", "m1")))


@query(
    "category_align",
    f"""WITH {q.FEATURES}, seen AS (SELECT DISTINCT district FROM train)
        SELECT coalesce(s.district, 'unknown') AS district, t.unit, {q.MONTH.replace("month,", "t.month,")}, t.y
        FROM test t LEFT JOIN seen s ON s.district = t.district""",
)
def category_align(spark, sf):
    """Segments that training has not seen become the unknown category in the test year."""
    table = stages.base_table(spark, sf)
    train = stages.train_rows(table)
    test = stages.test_rows(table).select("district", "unit", "month", "y")
    return show(trees.align_categories(test, train, ["district", "unit"]))


# --- accuracy -------------------------------------------------------------


@query(
    "predictions_table",
    f"""WITH {q.PREDICTIONS} SELECT {_KEYS}, y, naive, linear, blend, error,
        CASE WHEN y > 0 THEN {q.even("abs(error) / y * 100e0", 1)} END AS error_pct FROM pred""",
)
def predictions_table(spark, sf):
    return show(stages.predictions(spark, sf))


_MODELS = {"M0": "naive", "M1": "linear", "M2": "blend"}


def _metric_sql(label: str, column: str, digits: int | None = 2) -> str:
    def value(x: str) -> str:
        return q.rnd(x) if digits is None else q.even(x, digits)

    return f"""SELECT '{label}' AS model, '{ORDERS.test_year}' AS period, {value(f"avg(abs(y - {column}))")} AS mae,
        {value(f"sqrt(avg((y - {column}) * (y - {column})))")} AS rmse, {value(q.wmape("y", column))} AS wmape FROM pred"""


@query("metrics_by_model", f"WITH {q.PREDICTIONS} " + " UNION ALL ".join(_metric_sql(m, c) for m, c in _MODELS.items()))
def metrics_by_model(spark, sf):
    return reports.metrics_by_model(stages.predictions(spark, sf), _MODELS, str(ORDERS.test_year))


for _label, _column in _MODELS.items():

    @query(f"metrics_{_label.lower()}", f"WITH {q.PREDICTIONS} {_metric_sql(_label, _column, None)}")
    def metrics_one(spark, sf, label=_label, column=_column):
        rows = reports.metrics_by_model(
            stages.predictions(spark, sf), {label: column}, str(ORDERS.test_year), digits=None
        )
        return show(rows)


@query(
    "metrics_upsert",
    f"""WITH {q.PREDICTIONS}, now AS ({" UNION ALL ".join(_metric_sql(m, c) for m, c in _MODELS.items())})
        SELECT * FROM now WHERE model <> 'M2'
        UNION ALL SELECT model, period, {q.rnd("mae + 1")}, rmse, wmape FROM now WHERE model = 'M2'
        UNION ALL SELECT model, '1999', {q.rnd("mae + 1")}, rmse, wmape FROM now WHERE model = 'M2'""",
)
def metrics_upsert(spark, sf):
    """A row of a known model and period replaces the old one; another period is appended."""
    now = reports.metrics_by_model(stages.predictions(spark, sf), _MODELS, str(ORDERS.test_year))
    newer = now.filter(F.col("model") == "M2").withColumn("mae", F.col("mae") + 1)
    return show(reports.upsert_metrics(now, newer.unionByName(newer.withColumn("period", F.lit("1999")))))


@query(
    "metrics_r2",
    f"""WITH {q.HOLDOUT}, r AS (SELECT y, {q.even("m2", 0)} AS p FROM hold), m AS (SELECT avg(y) AS mean FROM r)
        SELECT {q.even("1 - sum((y - p) * (y - p)) / sum((y - mean) * (y - mean))", 2)} AS r2,
               {q.even("sqrt(avg((y - p) * (y - p)))", 1)} AS rmse, {q.even(q.wmape("y", "p"), 2)} AS wmape,
               {q.even("avg(abs(y - p))", 1)} AS mae FROM r CROSS JOIN m""",
)
def metrics_r2(spark, sf):
    return show(reports.holdout_metrics(stages.holdout(spark, sf), "m2"))


_MONTHLY = "CAST(sum(y) AS BIGINT) AS actual"


@query(
    "monthly_actual_vs_forecast",
    f"""WITH {q.PREDICTIONS} SELECT {q.MONTH}, {_MONTHLY}, {q.rnd("sum(blend)")} AS forecast,
        {q.rnd("sum(blend) * 0.9e0")} AS lo, {q.rnd("sum(blend) * 1.1e0")} AS hi FROM pred GROUP BY pred.month""",
)
def monthly_actual_vs_forecast(spark, sf):
    return show(reports.monthly_actual_vs_forecast(stages.predictions(spark, sf), "blend"))


@query(
    "district_summary",
    f"WITH {q.SUMMARY} SELECT district, actual, {q.rnd('forecast')} AS forecast, wmape FROM summary",
)
def district_summary(spark, sf):
    return show(reports.segment_summary(stages.predictions(spark, sf), "blend"))


_UNITS = f"""SELECT district, unit, CAST(sum(y) AS BIGINT) AS actual,
    CAST({q.even("sum(blend)", 0)} AS BIGINT) AS forecast,
    {q.even(f"coalesce({q.wmape('y', 'blend')}, 0)", 1)} AS wmape FROM pred GROUP BY district, unit"""


@query("unit_table", f"WITH {q.PREDICTIONS}, u AS ({_UNITS}) SELECT *, abs(actual - forecast) AS abs_error FROM u")
def unit_table(spark, sf):
    return show(reports.unit_table(stages.predictions(spark, sf), "blend"))


@query(
    "unit_table_top30",
    f"""WITH {q.PREDICTIONS}, u AS ({_UNITS})
        SELECT *, abs(actual - forecast) AS abs_error FROM u ORDER BY actual DESC, district, unit LIMIT 30""",
)
def unit_table_top30(spark, sf):
    table = reports.unit_table(stages.predictions(spark, sf), "blend")
    return show(reports.largest(table, 30, "actual", ["district", "unit"]))


@query(
    "monthly_top_districts",
    f"""WITH {q.PREDICTIONS}, top AS (SELECT district FROM pred GROUP BY district ORDER BY sum(y) DESC, district LIMIT 5)
        SELECT {q.MONTH}, district, {_MONTHLY}, {q.rnd("sum(blend)")} AS forecast
        FROM pred SEMI JOIN top USING (district) GROUP BY pred.month, district""",
)
def monthly_top_districts(spark, sf):
    return show(reports.monthly_top_segments(stages.durable(stages.predictions(spark, sf)), "blend"))


@query(
    "district_accuracy_topn",
    f"""WITH {q.SUMMARY} SELECT district, actual, {q.rnd("forecast")} AS forecast, wmape, {q.band("wmape")} AS band
        FROM (SELECT * FROM summary ORDER BY actual DESC, district LIMIT 10)""",
)
def district_accuracy_topn(spark, sf):
    summary = reports.segment_summary(stages.predictions(spark, sf), "blend")
    return show(reports.accuracy_topn(summary, 10))


@query(
    "accuracy_bands",
    f"""WITH {q.SUMMARY}, b AS (SELECT {q.band("wmape")} AS band, count(*) AS segments, CAST(sum(actual) AS BIGINT) AS volume
                             FROM summary GROUP BY 1)
        SELECT band, segments, volume, {q.even("segments / CAST(sum(segments) OVER () AS DOUBLE) * 100e0", 1)} AS segments_pct,
               {q.even("volume / CAST(sum(volume) OVER () AS DOUBLE) * 100e0", 1)} AS volume_pct FROM b""",
)
def accuracy_bands(spark, sf):
    return show(reports.accuracy_bands(reports.segment_summary(stages.predictions(spark, sf), "blend")))


@query(
    "scatter_points",
    f"""WITH {q.SUMMARY} SELECT district, substr(upper(district[1]) || lower(district[2:]), 1, 12) AS label, actual, wmape,
        {q.rnd("greatest(8, least(40, actual / 5000e0))")} AS size, {q.band("wmape")} AS band FROM summary""",
)
def scatter_points(spark, sf):
    return show(reports.scatter_points(reports.segment_summary(stages.predictions(spark, sf), "blend")))


def _title_sql(name: str) -> str:
    """Runs of letters capitalised, put together again with what stands between them."""
    runs = f"regexp_extract_all(lower({name}), '(\\p{{L}}+|[^\\p{{L}}]+)')"
    return f"array_to_string([upper(run[1]) || run[2:] FOR run IN {runs}], '')"


@query(
    "label_format",
    f"""WITH {q.SUMMARY} SELECT district, {_title_sql("district")} AS title, substr({_title_sql("district")}, 1, 12) AS label,
        format('{{:,}}', actual) AS volume_text, format('{{:.1f}}%', wmape) AS wmape_text FROM summary""",
)
def label_format(spark, sf):
    return reports.label_format(reports.segment_summary(stages.predictions(spark, sf), "blend"))


_COMPOUND = "(n_name || chr(39) || n_name || ' do-' || n_name)"


@query("title_case", f"SELECT n_nationkey, {_title_sql(_COMPOUND)} AS title FROM nation")
def title_case(spark, sf):
    """Names of several words, with an apostrophe and a hyphen."""
    compound = F.concat("n_name", F.lit("'"), "n_name", F.lit(" do-"), "n_name")
    return tables.table(spark, sf, "nation").select("n_nationkey", text.title_case(compound).alias("title"))


@query(
    "yearly_trend",
    f"""WITH {q.DENSE}, t AS (SELECT CAST(year(month) AS INTEGER) AS year, CAST(sum(y) AS BIGINT) AS cases
                           FROM dense GROUP BY 1 HAVING count(DISTINCT month) = 12)
        SELECT year, cases, {q.even("coalesce((cases - lag(cases) OVER (ORDER BY year)) / CAST(lag(cases) OVER (ORDER BY year) AS DOUBLE) * 100e0, 0)", 1)}
               AS change_pct FROM t""",
)
def yearly_trend(spark, sf):
    return show(reports.yearly_trend(stages.sparse_panel(spark, sf)))


@query(
    "kpis",
    f"""WITH {q.PREDICTIONS}, before AS (SELECT sum(y) AS b FROM dense WHERE year(month) = {ORDERS.test_year - 1})
        SELECT CAST(sum(y) AS BIGINT) AS cases_test_year,
               {q.even("(sum(y) - (SELECT b FROM before)) / CAST((SELECT b FROM before) AS DOUBLE) * 100e0", 1)} AS growth_pct,
               {q.even(q.wmape("y", "blend"), 2)} AS wmape, {q.even("avg(abs(y - blend))", 1)} AS mae,
               count(DISTINCT district) AS districts, count(DISTINCT unit) AS units,
               (SELECT CAST(sum(y) AS BIGINT) FROM dense) AS cases_history,
               (SELECT count(DISTINCT year(month)) FROM dense) AS years_history FROM pred""",
)
def kpis(spark, sf):
    sparse = stages.sparse_panel(spark, sf)
    rows = stages.test_rows(features.add_base_features(panel.zero_fill(sparse), rules=ORDERS.rules))
    scored = stages.with_forecasts(rows, ridge.PUBLISHED, ORDERS.alpha)
    predicted = reports.predictions_table(scored, F.col("m0"), F.col("m1"), F.col("m2"))
    return show(reports.kpis(predicted, sparse, "blend", ORDERS.test_year))


@query(
    "residual_pairs",
    f"WITH {q.PREDICTIONS} SELECT naive AS forecast, {q.rnd('y - naive')} AS residual FROM pred",
)
def residual_pairs(spark, sf):
    return show(reports.residual_pairs(stages.predictions(spark, sf), "naive"))


@query(
    "residual_histogram",
    f"""WITH {q.PREDICTIONS}, e AS (SELECT min(y - naive) AS lo, max(y - naive) AS hi FROM pred),
        c AS (SELECT least(floor((y - naive - lo) / (hi - lo) * 60e0), 59) + 1 AS bin, count(*) AS n
              FROM pred CROSS JOIN e GROUP BY 1)
        SELECT CAST(b.bin AS INTEGER) AS bin, {q.rnd("lo + (hi - lo) / 60e0 * (b.bin - 1)")} AS low,
               {q.rnd("lo + (hi - lo) / 60e0 * b.bin")} AS high, coalesce(c.n, 0) AS n
        FROM range(1, 61) b(bin) CROSS JOIN e LEFT JOIN c ON c.bin = b.bin""",
)
def residual_histogram(spark, sf):
    return show(reports.residual_histogram(stages.durable(stages.predictions(spark, sf)), "naive"))


# --- forecast -------------------------------------------------------------

_STEPS = f"""hist AS (SELECT district, unit, list(CAST(y AS DOUBLE) ORDER BY month) AS h, max(month) AS last_month
                    FROM dense GROUP BY district, unit),
area AS (SELECT district, unit, first(area_mode ORDER BY n DESC, area_mode) AS area_mode
         FROM (SELECT district, unit, area_mode, count(*) AS n FROM dense GROUP BY ALL) GROUP BY district, unit)"""


def _recursive_sql(prediction: str) -> str:
    return f"""WITH RECURSIVE {q.DENSE}, {_STEPS},
        start AS (SELECT hist.district, hist.unit, h, last_month AS month, area_mode
                  FROM hist JOIN area ON hist.district = area.district AND hist.unit = area.unit),
        ahead AS (
          SELECT district, unit, h, month, area_mode, 0 AS step FROM start
          UNION ALL
          SELECT district, unit, list_append(h, {prediction}), month, area_mode, step + 1 FROM (
            SELECT district, unit, h, CAST(month + INTERVAL 1 MONTH AS DATE) AS month, area_mode, step FROM ahead
            WHERE step < 12)),
        done AS (SELECT district, unit, month, h[-1] AS value FROM ahead WHERE step > 0)"""


_NAIVE_SQL = _recursive_sql("greatest(h[-12], 0e0)")
_HISTORY_VALUES = {
    **{f"lag_{k}": f"h[-{k}]" for k in features.LAGS},
    **{f"rolling_mean_{w}": f"list_avg(h[-{w}:])" for w in features.WINDOWS},
    "rolling_std_3": "list_aggregate(h[-3:], 'stddev_samp')",
    **q.CALENDAR_SQL,
    **q.AREA_SQL,
    "is_flag_year": "0",
}
_RIDGE_SQL = _recursive_sql(q.ridge(_HISTORY_VALUES))
_AHEAD = f"SELECT {_KEYS}, {q.rnd('value')} AS value, CAST({q.even('value', 0)} AS BIGINT) AS forecast FROM done"


@query("forecast_naive", f"{_NAIVE_SQL} {_AHEAD}")
def forecast_naive(spark, sf):
    return show(forecast.forecast_naive(stages.dense_panel(spark, sf)))


@query("forecast_ridge", f"{_RIDGE_SQL} {_AHEAD}")
def forecast_ridge(spark, sf):
    dense = stages.durable(stages.dense_panel(spark, sf))
    return show(forecast.forecast_ridge(dense, ridge.PUBLISHED, ORDERS.rules))


@query(
    "forecast_totals",
    f"""{_NAIVE_SQL}, t AS (SELECT month, CAST(sum(CAST(round_even(value, 0) AS BIGINT)) AS BIGINT) AS total,
                                  row_number() OVER (ORDER BY month) AS i FROM done GROUP BY month)
        SELECT {q.MONTH}, total, CAST((SELECT sum(total) FROM t WHERE i <= 6) AS BIGINT) AS first_half,
               CAST((SELECT sum(total) FROM t) AS BIGINT) AS full_year FROM t""",
)
def forecast_totals(spark, sf):
    return show(reports.forecast_totals(forecast.forecast_naive(stages.dense_panel(spark, sf))))


def _tree_table(spark, sf, extended_features: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    dense = stages.durable(stages.dense_panel(spark, sf))
    if extended_features:
        table, numeric = stages.full_features(dense), extended.NUMERIC_FEATURES
    else:
        table, numeric = features.add_base_features(dense, rules=ORDERS.rules), features.BASE_FEATURES
    return dense, stages.durable(extended.zero_nulls(split.drop_warmup(table), numeric)), numeric


# Fitted models of this process's sessions, by application, tables, their state and features: where they are stored.
_STORED_TREES: dict[tuple, str] = {}


def _trees(spark, sf, extended_features: bool, table: DataFrame, numeric: list[str]) -> trees.TreeModel:
    """The model of the five tree queries: fitted by the first of them, loaded by the others.

    Trees are counted on the last training year; the test year is for scoring only.
    """
    place = (spark.sparkContext.applicationId, sf, extended_features, *tables.stamps(spark, sf))
    if place not in _STORED_TREES:
        earlier = table.filter(split.in_years(last=ORDERS.last_train_year - 1))
        last = table.filter(split.in_years(first=ORDERS.last_train_year, last=ORDERS.last_train_year))
        params = trees.EXTENDED_TREES if extended_features else trees.BASE_TREES
        model = trees.fit_trees(earlier, numeric, params=params, validation=last)
        path = f"{spark.sparkContext.getCheckpointDir()}/trees-{uuid.uuid4().hex}"
        model.save(path)
        _STORED_TREES[place] = path
    return trees.TreeModel.load(spark, _STORED_TREES[place])


def _tree_predictions(spark, sf, extended_features: bool) -> DataFrame:
    _, table, numeric = _tree_table(spark, sf, extended_features)
    model = _trees(spark, sf, extended_features, table, numeric)
    test = table.filter(split.in_years(first=ORDERS.test_year, last=ORDERS.test_year))
    return model.predict(test)


@query("model_gbt")
def model_gbt(spark, sf):
    return show(_tree_predictions(spark, sf, False).select("district", "unit", "month", "y", "forecast"))


@query("model_gbt_exotic")
def model_gbt_exotic(spark, sf):
    return show(_tree_predictions(spark, sf, True).select("district", "unit", "month", "y", "forecast"))


@query("metrics_trees")
def metrics_trees(spark, sf):
    """Accuracy of both boosted models beside the naive one and the fitted linear one."""
    scored = _tree_predictions(spark, sf, False).withColumnRenamed("forecast", "m3")
    wide = _tree_predictions(spark, sf, True).select("district", "unit", "month", F.col("forecast").alias("m4"))
    scored = scored.join(wide, ["district", "unit", "month"])
    scored = stages.with_forecasts(scored, _fitted(spark, sf), ORDERS.alpha)
    return reports.metrics_by_model(stages.durable(scored), {f"M{i}": f"m{i}" for i in range(5)}, str(ORDERS.test_year))


@query("gbt_importance")
def gbt_importance(spark, sf):
    _, table, numeric = _tree_table(spark, sf, False)
    return show(reports.largest(_trees(spark, sf, False, table, numeric).importance(spark), 15, "importance", ["feature"]))


@query("forecast_gbt")
def forecast_gbt(spark, sf):
    dense, table, numeric = _tree_table(spark, sf, False)
    return show(forecast.forecast_trees(dense, _trees(spark, sf, False, table, numeric), ORDERS.rules))


@query("forecast_gbt_exotic")
def forecast_gbt_exotic(spark, sf):
    dense, table, numeric = _tree_table(spark, sf, True)
    model = _trees(spark, sf, True, table, numeric)
    return show(forecast.forecast_trees(dense, model, ORDERS.rules, extended=True, epoch_year=ORDERS.epoch_year))


_FOLD = "CAST('0x' || substr(md5(district || '|' || unit), 1, 6) AS INTEGER) % 5"


@query(
    "target_means",
    f"""WITH {q.DENSE}, rows AS (SELECT district, {_FOLD} AS fold, y FROM dense WHERE year(month) <= {ORDERS.last_train_year}),
        m AS (SELECT avg(y) AS overall FROM rows), t AS (SELECT district, sum(y) AS s, count(*) AS n FROM rows GROUP BY 1),
        p AS (SELECT district, fold, sum(y) AS s, count(*) AS n FROM rows GROUP BY 1, 2)
        SELECT t.district, CAST(f.fold AS INTEGER) AS fold,
               {q.rnd("(t.s - coalesce(p.s, 0) + 20e0 * m.overall) / (t.n - coalesce(p.n, 0) + 20e0)")} AS district_level
        FROM t CROSS JOIN range(5) f(fold) CROSS JOIN m LEFT JOIN p ON p.district = t.district AND p.fold = f.fold""",
)
def target_means(spark, sf):
    """The out-of-fold means that stand for districts in the boosted models."""
    rows = stages.durable(stages.dense_panel(spark, sf).filter(split.in_years(last=ORDERS.last_train_year)))
    overall = rows.agg(F.avg("y")).first()[0]
    return show(trees.fold_levels(rows, "district", overall, ["district", "unit"]))


# --- cube -----------------------------------------------------------------

_NAMES = ", ".join(f"'{m}'" for m in cube.MONTH_NAMES)
_CUBE = f"""{_NAIVE_SQL},
lagged AS (SELECT *, {q.lag(12)} AS l FROM dense),
fc AS (
  SELECT district, unit, month, CAST(round_even(value, 0) AS BIGINT) AS p FROM done
  UNION ALL
  SELECT district, unit, month, CAST(round_even(greatest(CAST(l AS DOUBLE), 0), 0) AS BIGINT) FROM lagged
  WHERE l IS NOT NULL AND year(month) = {ORDERS.test_year}),
old AS (SELECT * FROM dense WHERE year(month) >= {ORDERS.cube_first_year}),
cal AS (SELECT CAST(unnest(generate_series(DATE '{ORDERS.cube_first_year}-01-01', DATE '2002-12-01', INTERVAL 1 MONTH)) AS DATE) AS month),
members AS (
  SELECT DISTINCT district, unit FROM old UNION SELECT DISTINCT district, 'ALL' FROM old UNION SELECT 'ALL', 'ALL'),
a AS (
  SELECT district, unit, month, sum(y) AS v FROM old GROUP BY ALL
  UNION ALL SELECT district, 'ALL', month, sum(y) FROM old GROUP BY ALL
  UNION ALL SELECT 'ALL', 'ALL', month, sum(y) FROM old GROUP BY ALL),
p AS (
  SELECT district, unit, month, sum(p) AS v FROM fc GROUP BY ALL
  UNION ALL SELECT district, 'ALL', month, sum(p) FROM fc GROUP BY ALL
  UNION ALL SELECT 'ALL', 'ALL', month, sum(p) FROM fc GROUP BY ALL),
flat AS (
  SELECT m.district, m.unit, cal.month,
         CASE WHEN cal.month <= DATE '2001-08-01' THEN CAST(coalesce(a.v, 0) AS BIGINT) END AS actual,
         CASE WHEN year(cal.month) = {ORDERS.test_year} OR cal.month BETWEEN DATE '2001-09-01' AND DATE '2002-08-01'
              THEN CAST(coalesce(p.v, 0) AS BIGINT) END AS forecast
  FROM members m CROSS JOIN cal
  LEFT JOIN a ON a.district = m.district AND a.unit = m.unit AND a.month = cal.month
  LEFT JOIN p ON p.district = m.district AND p.unit = m.unit AND p.month = cal.month),
cube AS (
  SELECT district, unit, CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month_no,
         ([{_NAMES}])[month(month)] AS month_name, actual, forecast,
         CAST(trunc(forecast * 0.85e0) AS BIGINT) AS lo, CAST(trunc(forecast * 1.15e0) AS BIGINT) AS hi
  FROM flat)"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("actual", "forecast", "lo", "hi"))


def _cube(spark, sf) -> DataFrame:
    return stages.cube_of(stages.durable(stages.dense_panel(spark, sf)))


# Cubes stored by this process's sessions, by application and state of the tables.
_STORED_CUBES: dict[tuple, str] = {}


def _stored_cube(spark, sf) -> str:
    """Where the cube of these tables is stored; the first query on it writes it, changed tables write a new one."""
    place = (spark.sparkContext.applicationId, sf, *tables.stamps(spark, sf))
    if place not in _STORED_CUBES:
        cells = _cube(spark, sf)
        path = f"{spark.sparkContext.getCheckpointDir()}/cube-{uuid.uuid4().hex}"
        sinks.write_cube_table(cells, path)
        _STORED_CUBES[place] = path
    return _STORED_CUBES[place]


@query("forecast_cube", f"{_CUBE} SELECT * FROM cube")
def forecast_cube(spark, sf):
    return _cube(spark, sf)


@query("cube_by_year", f"{_CUBE} SELECT district, unit, year, {_SUMS} FROM cube GROUP BY district, unit, year")
def cube_by_year(spark, sf):
    return cube.cube_by_year(_cube(spark, sf))


@query(
    "cube_slice",
    f"""{_CUBE} SELECT month_name AS label, actual, forecast, lo, hi FROM cube
        WHERE district = 'NATION_7' AND unit = 'BUILDING' AND year = {ORDERS.test_year}""",
)
def cube_slice(spark, sf):
    cells = sinks.read_cube_table(spark, _stored_cube(spark, sf), "NATION_7")
    return cube.cube_slice(cells, "NATION_7", "BUILDING", ORDERS.test_year)


@query(
    "cube_slice_years",
    f"""{_CUBE} SELECT CAST(year AS VARCHAR) AS label, {_SUMS} FROM cube
        WHERE district = 'NATION_7' AND unit = 'ALL' GROUP BY year""",
)
def cube_slice_years(spark, sf):
    """All years of a segment; the unit asked for does not exist, so the whole segment answers."""
    cells = sinks.read_cube_table(spark, _stored_cube(spark, sf), "NATION_7")
    return cube.cube_slice(cells, "NATION_7", "NO SUCH UNIT")


@query(
    "cube_totals",
    f"""{_CUBE} SELECT CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(forecast) AS BIGINT) AS forecast
        FROM cube WHERE district = 'ALL' AND unit = 'ALL' AND year = {ORDERS.test_year}""",
)
def cube_totals(spark, sf):
    cells = sinks.read_cube_table(spark, _stored_cube(spark, sf), cube.ALL, totals=True)
    return cube.cube_totals(cube.cube_slice(cells, year=ORDERS.test_year))


@query("hierarchy", f"WITH {q.SPARSE} SELECT DISTINCT district, unit FROM cnt")
def hierarchy(spark, sf):
    return cube.hierarchy(stages.sparse_panel(spark, sf))


@query(
    "cube_split",
    f"""WITH {q.SPARSE}, d AS (SELECT DISTINCT district FROM cnt)
        SELECT district, CASE WHEN dense_rank() OVER (ORDER BY district) <= (SELECT count(*) FROM d) // 2
                              THEN 1 ELSE 2 END AS bucket FROM d UNION ALL SELECT 'ALL', 1""",
)
def cube_split(spark, sf):
    return cube.cube_split(stages.durable(_cube(spark, sf).select("district", "unit").distinct()))


@query("cube_json")
def cube_json(spark, sf):
    return cube.cube_documents(sinks.read_cube_table(spark, _stored_cube(spark, sf)))


@query(
    "cube_json_cells",
    f"""{_CUBE}, d AS (SELECT DISTINCT district FROM members WHERE district <> 'ALL'),
        half AS (SELECT district, CASE WHEN row_number() OVER (ORDER BY district) <= (SELECT count(*) FROM d) // 2
                                       THEN 1 ELSE 2 END AS bucket FROM d UNION ALL SELECT 'ALL', 1)
        SELECT CAST(bucket AS INTEGER) AS bucket, cube.* FROM cube JOIN half USING (district)""",
)
def cube_json_cells(spark, sf):
    """The documents written in two halves, and both read back as cells."""
    path = f"{_stored_cube(spark, sf)}-documents-{uuid.uuid4().hex}"
    sinks.write_cube(cube_json(spark, sf), path)
    return sinks.read_cube(spark, path)


@query("cube_tree")
def cube_tree(spark, sf):
    """The nested document of both halves in ordered fragments."""
    return cube.cube_tree(stages.durable(cube_json(spark, sf)))
