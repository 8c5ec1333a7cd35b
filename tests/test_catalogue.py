"""Every query against its SQL statement on the driver tables."""

import json

import pytest

import __spark_entry__ as entry
import check

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, oracle, sf):
    assert check.difference(QUERIES[name](spark, sf), oracle, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["ridge_fit", "ridge_importance"])
def test_has_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_fragments_of_the_cube(spark, sf):
    """Fragments in order spell the two halves; their cells are those of the documents."""
    halves = {}
    for r in QUERIES["cube_tree"](spark, sf).orderBy("bucket", "district", "unit").collect():
        halves[r["bucket"]] = halves.get(r["bucket"], "") + r["fragment"]
    found = {
        (d, u, int(y), m): tuple(cell.values())
        for text in halves.values() for d, units in json.loads(text).items()
        for u, years in units.items() for y, months in years.items() for m, cell in months.items()
    }
    rows = QUERIES["cube_json_cells"](spark, sf).collect()
    assert found == {(r["district"], r["unit"], r["year"], r["month_name"]): (r["actual"], r["forecast"], r["lo"], r["hi"]) for r in rows}
    assert len(found) == len(rows)


def _keys(df):
    return sorted((r["district"], r["unit"], r["month"]) for r in df.collect())


@pytest.mark.parametrize("suffix", ["", "_exotic"])
def test_tree_queries_cover_the_holdout_and_the_horizon(suffix, spark, sf):
    """Keys and actual values are those of the naive model's rows, forecasts those of its recursion."""
    scored, naive = QUERIES[f"model_gbt{suffix}"](spark, sf), QUERIES["model_m0"](spark, sf)
    assert _keys(scored) == _keys(naive)
    assert scored.agg({"y": "sum"}).first()[0] == naive.agg({"y": "sum"}).first()[0]
    assert scored.where("forecast is null or forecast < 0").count() == 0
    ahead = QUERIES[f"forecast_gbt{suffix}"](spark, sf)
    assert _keys(ahead) == _keys(QUERIES["forecast_naive"](spark, sf))


def test_boosted_models_beat_the_naive_one(spark, sf):
    errors = {r["model"]: r["wmape"] for r in QUERIES["metrics_trees"](spark, sf).collect()}
    assert errors["M3"] < errors["M0"] and errors["M4"] < errors["M0"]
    assert QUERIES["gbt_importance"](spark, sf).count() == 15


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 25
