"""Small panels written by hand."""

import datetime as dt

#: Tables of the whole runs.
SMALL = "/root/testdata/sf0.001"

PANEL = "district string, unit string, month date, y long, area_mode string"


def month(i, year=2020):
    """The i-th month from January of ``year``."""
    return dt.date(year + i // 12, i % 12 + 1, 1)


def series(values, district="A", unit="u", year=2020, area="Cível"):
    return [(district, unit, month(i, year), v, area) for i, v in enumerate(values)]


def panel(spark, *parts):
    return spark.createDataFrame([row for part in parts for row in part], PANEL)


def column(df, name, by=("district", "unit", "month"), digits=5):
    values = [row[name] for row in df.orderBy(*by).collect()]
    return [round(v, digits) if isinstance(v, float) else v for v in values]
