"""The cube and the queries on it."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from helpers import month, panel, series
from panelcast.operators import cube
from panelcast.sources import sinks

FORECAST = "district string, unit string, month date, forecast long"


@pytest.fixture(scope="module")
def small(spark):
    history = panel(spark, series([1] * 24, unit="u"), series([2] * 24, unit="v"), series([3] * 24, district="B"))
    ahead = [("A", "u", month(24 + i), 100) for i in range(12)] + [("C", "new", month(24), 7)]
    forecasts = spark.createDataFrame(ahead, FORECAST)
    span = (dt.date(2022, 1, 1), dt.date(2022, 12, 1))
    return cube.forecast_cube(history, forecasts, 2020, 2022, dt.date(2021, 12, 1), [span]).cache()


def member(df, district, unit, year, month_no):
    keys = {"district": district, "unit": unit, "year": year, "month_no": month_no}
    rows = df
    for name, value in keys.items():
        rows = rows.filter(F.col(name) == value)
    return tuple(rows.select("actual", "forecast", "lo", "hi").first())


def test_dense_members(small):
    # Three series, two segments, everything; 36 months each. The unknown series is no member.
    assert small.count() == (3 + 2 + 1) * 36
    assert small.filter(F.col("district") == "C").count() == 0


def test_cells(small):
    assert member(small, "A", "u", 2020, 1) == (1, None, None, None)
    assert member(small, "A", "u", 2022, 1) == (None, 100, 85, 114)
    assert member(small, "A", "v", 2022, 1) == (None, 0, 0, 0)
    assert member(small, "ALL", "ALL", 2022, 1) == (None, 107, 90, 123)
    assert member(small, "A", "ALL", 2021, 6) == (3, None, None, None)


def test_actuals_add_up(small):
    leaves = small.filter(F.col("unit") != "ALL").agg(F.sum("actual")).first()[0]
    top = small.filter(F.col("district") == "ALL").agg(F.sum("actual")).first()[0]
    assert leaves == top == 24 * 6


def test_yearly_view(small):
    years = {r["label"]: tuple(r)[1:] for r in cube.cube_slice(small, "A", "u").collect()}
    assert years["2020"] == (12, None, None, None)
    # Yearly bands add the monthly bands.
    assert years["2022"] == (None, 1200, 85 * 12, 114 * 12)


def test_slice_and_fallback(small):
    one = cube.cube_slice(small, "A", "v", 2021, 3).collect()
    assert [tuple(r) for r in one] == [("Mar", 2, None, None, None)]
    fallback = cube.cube_slice(small, "B", "v", 2021, 3).collect()
    assert [r["actual"] for r in fallback] == [3]


def test_totals(small):
    assert tuple(cube.cube_totals(cube.cube_slice(small, year=2022)).first()) == (None, 1207)


def test_documents_and_split(small):
    rows = {(r["district"], r["unit"]): r for r in cube.cube_documents(small).collect()}
    assert len(rows) == 6
    assert {k[0]: r["bucket"] for k, r in rows.items()} == {"ALL": 1, "A": 1, "B": 2}
    cell = json.loads(rows["A", "u"]["document"])["2022"]["Fev"]
    assert cell == {"actual": None, "forecast": 100, "lo": 85, "hi": 114}


@pytest.fixture(scope="module")
def stored(small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cube") / "table")
    sinks.write_cube_table(small, path)
    return path


def test_stored_cube_is_the_cube(small, stored, spark):
    rows = sinks.read_cube_table(spark, stored)
    assert rows.columns == small.columns
    assert rows.exceptAll(small).count() == small.exceptAll(rows).count() == 0


@pytest.mark.parametrize("asked", [("A", "u", 2022), ("A", "nobody", None), ("B", "ALL", 2021), ("ALL", "ALL", None), ("Z", "u", 2021)])
def test_slices_of_the_stored_cube(small, stored, spark, asked):
    cells = sinks.read_cube_table(spark, stored, asked[0], totals=asked[1] == "ALL")
    found, wanted = cube.cube_slice(cells, *asked), cube.cube_slice(small, *asked)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in plan and "bucket#" in plan and "Expand" not in plan
    assert ("part#" in plan.split("PartitionFilters")[1].split("]")[0]) == (asked[1] == "ALL")


def test_both_halves_are_read_back(small, tmp_path, spark):
    path = str(tmp_path / "documents")
    sinks.write_cube(cube.cube_documents(small), path)
    rows = sinks.read_cube(spark, path)
    assert {(r["district"], r["bucket"]) for r in rows.collect()} == {("ALL", 1), ("A", 1), ("B", 2)}
    rows = rows.select(small.columns)
    assert rows.exceptAll(small).count() == small.exceptAll(rows).count() == 0


def test_fragments_spell_one_document_a_half(spark, tmp_path):
    """Names with quotes, brackets and line ends; many units in one segment; the files in order are JSON."""
    names = [("A[1]", f'u"{i}\n') for i in range(40)] + [("B\\]", "v"), ("C", "w"), ("ALL", "ALL")]
    names += [(d, "ALL") for d in ("A[1]", "B\\]", "C")]
    rows = [(d, u, 2020, m, cube.MONTH_NAMES[m - 1], i, None, None, None) for i, (d, u) in enumerate(names) for m in (1, 12)]
    cells = "district string, unit string, year int, month_no int, month_name string, actual long, forecast long, lo long, hi long"
    documents = cube.cube_documents(spark.createDataFrame(rows, cells).repartition(5))
    sinks.write_cube_tree(cube.cube_tree(documents), str(tmp_path / "tree"))
    found = {}
    for half in (1, 2):
        files = sorted((tmp_path / "tree" / f"bucket={half}").glob("part-*"))
        tree = json.loads("".join(f.read_text() for f in files))
        for district, units in tree.items():
            assert (half == 1) == (district in ("ALL", "A[1]"))
            found.update({(district, u): years["2020"] for u, years in units.items()})
    assert set(found) == set(names)
    assert all([found[n][m]["actual"] for m in ("Jan", "Dez")] == [i, i] for i, n in enumerate(names))


def test_nothing_has_no_documents(small, tmp_path, spark):
    sinks.write_cube_table(small.limit(0), str(tmp_path / "empty"))
    documents = cube.cube_documents(small.limit(0))
    assert documents.count() == cube.cube_tree(documents).count() == 0


def test_hierarchy(spark):
    df = panel(spark, series([1], unit="v"), series([1], unit="u"), series([1], district="B"))
    rows = {r["district"]: r["units"] for r in cube.hierarchy_documents(df).collect()}
    assert rows == {"A": ["u", "v"], "B": ["u"]}
