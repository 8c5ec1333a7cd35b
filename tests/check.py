"""Compare a Spark result with the result of its SQL statement on the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_value(row[n]) for n in names) for row in df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    places = [columns.index(n) for n in names]
    return names, Counter(tuple(_value(row[p]) for p in places) for row in result.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when equal, otherwise a short description."""
    spark_names, got = spark_rows(df)
    sql_names, expected = sql_rows(con, sql)
    if spark_names != sql_names:
        return f"columns differ: {spark_names} / {sql_names}"
    if got == expected:
        return None
    only_spark, only_sql = got - expected, expected - got
    return (
        f"{sum(got.values())} rows / {sum(expected.values())} expected; "
        f"{sum(only_spark.values())} unmatched, e.g. {sorted(map(str, only_spark))[:2]} / {sorted(map(str, only_sql))[:2]}"
    )
