"""SQL fragments for the oracle statements of the catalogue.

They say in plain SQL what the queries compute, with none of the library's
techniques: cross joins, row-order windows over whole segments and recursive
statements are fine here, as they only serve to check results on small data.
"""

from __future__ import annotations

import math

from panelcast.models.ridge import PUBLISHED, SCALE_GUARD
from panelcast.operators.features import BASE_FEATURES, LAGS, WINDOWS
from panelcast.plans.stages import ORDERS


def num(x: float) -> str:
    """A DOUBLE literal (a plain decimal literal would be a DECIMAL)."""
    text = repr(float(x))
    return text if "e" in text else f"{text}e0"


def rnd(expression: str, digits: int = 6) -> str:
    """Rounded DOUBLE without negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0e0)"


def even(expression: str, digits: int) -> str:
    return f"(round_even(round(CAST({expression} AS DOUBLE), 9), {digits}) + 0e0)"


MONTH = "strftime(month, '%Y-%m') AS month"

RECORDS = """
rec AS (
  SELECT o_orderkey AS case_id, CAST(o_orderdate AS DATE) AS received_at,
         upper(trim(n_name)) AS district, trim(c_mktsegment) AS unit,
         o_orderstatus AS area, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE n_name IS NOT NULL AND c_mktsegment IS NOT NULL
)"""

SPARSE = f"""{RECORDS},
cnt AS (
  SELECT district, unit, month, CAST(sum(c) AS BIGINT) AS y,
         coalesce(first(area ORDER BY n DESC, area) FILTER (area IS NOT NULL), 'N/A') AS area_mode
  FROM (SELECT district, unit, CAST(date_trunc('month', received_at) AS DATE) AS month, area,
               count(case_id) AS c, count(*) AS n
        FROM rec GROUP BY ALL)
  GROUP BY district, unit, month
)"""

DENSE = f"""{SPARSE},
months AS (SELECT DISTINCT month FROM cnt),
series AS (SELECT DISTINCT district, unit FROM cnt),
unit_area AS (
  SELECT unit, first(area_mode ORDER BY n DESC, area_mode) AS area_fill
  FROM (SELECT unit, area_mode, count(*) AS n FROM cnt GROUP BY ALL) GROUP BY unit
),
dense AS (
  SELECT s.district, s.unit, m.month, CAST(coalesce(c.y, 0) AS BIGINT) AS y,
         coalesce(c.area_mode, f.area_fill) AS area_mode
  FROM months m CROSS JOIN series s
  LEFT JOIN cnt c ON c.district = s.district AND c.unit = s.unit AND c.month = m.month
  LEFT JOIN unit_area f ON f.unit = s.unit
)"""

SERIES = "PARTITION BY district, unit ORDER BY month"


def past(rows: int, skip: int = 0) -> str:
    return f"OVER ({SERIES} ROWS BETWEEN {rows + skip} PRECEDING AND {1 + skip} PRECEDING)"


ALL_PAST = f"OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def lag(k: int) -> str:
    return f"lag(y, {k}) OVER ({SERIES})"


LAG_SQL = {f"lag_{k}": lag(k) for k in LAGS}
ROLLING_SQL = {
    **{f"rolling_mean_{w}": f"avg(y) {past(w)}" for w in WINDOWS},
    "rolling_std_3": f"stddev_samp(y) {past(3)}",
}
_ANGLE = f"({num(2.0 * math.pi)} * month(month) / 12e0)"
_FLAGGED = ", ".join(str(y) for y in ORDERS.rules.flag_years)
CALENDAR_SQL = {
    "month_of_year": "CAST(month(month) AS INTEGER)",
    "quarter": "CAST(quarter(month) AS INTEGER)",
    "is_recess": "CAST(month(month) IN (1, 7) AS INTEGER)",
    "is_flag_year": f"CAST(year(month) IN ({_FLAGGED}) AS INTEGER)",
    "month_sin": f"sin({_ANGLE})",
    "month_cos": f"cos({_ANGLE})",
}
AREA_SQL = {"area_flag": f"CAST(area_mode = '{ORDERS.rules.flag_area}' AS INTEGER)"}
BASE_SQL = {**LAG_SQL, **ROLLING_SQL, **CALENDAR_SQL, **AREA_SQL}


def columns(features: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in features.items())


FEATURES = f"""{DENSE},
feat AS (SELECT *, {columns(BASE_SQL)} FROM dense),
clean AS (SELECT * FROM feat WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*LAG_SQL, *ROLLING_SQL])}),
train AS (SELECT * FROM clean WHERE year(month) <= {ORDERS.last_train_year}),
test AS (SELECT * FROM clean WHERE year(month) = {ORDERS.test_year})"""


def ridge(values: dict[str, str]) -> str:
    """The published linear model over SQL expressions for its features."""
    terms = [num(PUBLISHED.beta[0])]
    for name, mean, std, weight in zip(BASE_FEATURES, PUBLISHED.means, PUBLISHED.stds, PUBLISHED.beta[1:]):
        terms.append(f"(CAST({values[name]} AS DOUBLE) - {num(mean)}) / {num(std + SCALE_GUARD)} * {num(weight)}")
    return f"greatest({' + '.join(terms)}, 0e0)"


HOLDOUT = f"""{FEATURES},
scored AS (
  SELECT *, greatest(CAST(lag_12 AS DOUBLE), 0e0) AS m0, {ridge({c: c for c in BASE_FEATURES})} AS m1 FROM test
),
hold AS (
  SELECT *, greatest({num(ORDERS.alpha)} * m0 + {num(1.0 - ORDERS.alpha)} * m1, 0e0) AS m2 FROM scored
)"""

PREDICTIONS = f"""{HOLDOUT},
pred AS (
  SELECT *, {even("y - blend", 1)} AS error FROM (
    SELECT month, district, unit, y, {even("m0", 1)} AS naive, {even("m1", 1)} AS linear, {even("m2", 1)} AS blend
    FROM hold)
)"""


def wmape(y: str, p: str) -> str:
    return f"(sum(abs({y} - {p})) / nullif(CAST(sum(abs({y})) AS DOUBLE), 0) * 100e0)"


def band(w: str) -> str:
    return f"CASE WHEN {w} < 20 THEN '<20' WHEN {w} < 35 THEN '20-35' ELSE '>35' END"


SUMMARY = f"""{PREDICTIONS},
summary AS (
  SELECT district, CAST(sum(y) AS BIGINT) AS actual, sum(blend) AS forecast,
         {even(f"coalesce({wmape('y', 'blend')}, 0)", 1)} AS wmape
  FROM pred GROUP BY district
)"""
