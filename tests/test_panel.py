"""Panel construction: counts, modes, grid, splits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import column, month, panel, series
from panelcast.operators import features, panel as ops, profile, split
from panelcast.sources import records

RECORDS = "case_id string, received_at date, district string, unit string, area string"


def test_mode_ties_and_default(spark):
    day = dt.date(2020, 1, 5)
    rows = [("1", day, "A", "u", a) for a in ("b", "a", "a", "b")] + [("2", day, "A", "v", None)]
    counts = ops.monthly_counts(spark.createDataFrame(rows, RECORDS)).orderBy("unit").collect()
    assert [(r["unit"], r["y"], r["area_mode"]) for r in counts] == [("u", 4, "a"), ("v", 1, "N/A")]


def test_count_skips_missing_ids(spark):
    day = dt.date(2020, 1, 5)
    rows = [("1", day, "A", "u", "a"), (None, day, "A", "u", "a"), ("3", day, None, "u", "a")]
    counts = ops.monthly_counts(spark.createDataFrame(rows, RECORDS)).collect()
    assert [(r["district"], r["y"]) for r in counts] == [("A", 1)]


def test_clean_keys(spark):
    rows = [(None, "x"), (" Abc ", "\tu v\n")]
    cleaned = records.clean_keys(spark.createDataFrame(rows, "district string, unit string")).collect()
    assert [tuple(r) for r in cleaned] == [("ABC", "u v")]


def test_zero_fill_keeps_totals(spark):
    sparse = panel(spark, series([2, 3]), [("B", "u", month(3), 4, "x")])
    dense = ops.zero_fill(sparse)
    assert dense.count() == 3 * 2
    assert dense.agg(F.sum("y")).first()[0] == 9
    filled = dense.filter((F.col("district") == "B") & (F.col("y") == 0)).select("area_mode").distinct().collect()
    # The inner segment's areas: twice the one, once the other.
    assert [r[0] for r in filled] == ["Cível"]


def test_calendar_grid_fills_the_gap(spark):
    sparse = panel(spark, series([1] * 12, year=2018), series([2] * 12, year=2020))
    assert ops.zero_fill(sparse).count() == 24
    calendar = features.add_lags(ops.zero_fill(sparse, grid="calendar"))
    assert calendar.count() == 36
    assert calendar.filter(F.col("month") == month(0, 2020)).first()["lag_12"] == 0


def test_salted_join_is_a_left_join(spark):
    left = spark.createDataFrame([("k", f"s{i}") for i in range(50)] + [("m", "s")], "k string, s string")
    right = spark.createDataFrame([("k", 1)], "k string, v int")
    got = ops.salted_left_join(left, right, ["k"], "s")
    assert got.count() == 51
    assert got.filter(F.col("v") == 1).count() == 50


def test_warmup_is_twelve_rows(spark):
    table = features.add_base_features(panel(spark, series(list(range(30))), series([1] * 12, unit="v")))
    assert column(split.drop_warmup(table), "y") == list(range(12, 30))


def test_split_and_leakage(spark):
    table = features.add_base_features(panel(spark, series(list(range(36)))))
    assert split.train_part(table, 2021).count() == 12
    assert split.test_part(table, 2022).count() == 12
    split.assert_no_leakage(split.drop_warmup(table), 2021, 2022)
    with pytest.raises(ValueError):
        split.assert_no_leakage(split.drop_warmup(table), 2022, 2021)


def test_dedup_by_explicit_order(spark):
    rows = panel(spark, series([5]), series([3]), series([4]))
    assert column(ops.dedup_panel(rows), "y") == [3]
    assert column(ops.dedup_panel(rows, order=-F.col("y")), "y") == [5]


def test_tail(spark):
    assert column(ops.tail(panel(spark, series(list(range(30)))), 24), "y") == list(range(6, 30))


def test_sketches_of_columns(spark):
    """Sketches of groups, united, estimate what one sketch of all does; few values are counted exactly, nulls are none."""
    df = spark.range(50_000).select(
        (F.col("id") % 7).alias("part"), "id", (F.col("id") % 1000).cast("double").alias("few"),
        F.lit(None).cast("date").alias("none"), F.when(F.col("id") % 3 > 0, F.lit("x")).alias("text"),
    )
    by_part = profile.column_sketches(df, ["part"])
    assert by_part.count() == 7 * 4 and by_part.agg(F.max(F.length("sketch"))).first()[0] < 5000
    rows = {r["column"]: r for r in profile.sketched_overview(by_part).collect()}
    assert rows == {r["column"]: r for r in profile.sketched_overview(profile.column_sketches(df.drop("part"))).collect()}
    assert abs(rows["id"]["distinct_values"] - 50_000) < 0.05 * 50_000 and abs(rows["few"]["distinct_values"] - 1000) < 50
    assert (rows["none"]["distinct_values"], rows["none"]["nulls_pct"]) == (0, 100.0)
    assert (rows["text"]["distinct_values"], rows["text"]["nulls"], rows["few"]["type"]) == (1, 16_667, "double")
    assert profile.sketched_overview(by_part, ["part"]).count() == 28
    assert all(r["distinct_values"] == 0 for r in profile.sketched_overview(profile.column_sketches(df.limit(0))).collect())


def test_area_of_earlier_months(spark):
    """Own and later months are not used, ties go to the smaller name, a null area does not count, no past gives the default."""
    rows = [
        ("A", "u", month(0), 1, "x"), ("B", "u", month(0), 1, "w"), ("A", "u", month(1), 1, "x"),
        ("B", "u", month(2), 1, "z"), ("C", "u", month(3), 1, "z"), ("A", "u", month(3), 1, "z"), ("C", "v", month(3), 1, None),
    ]
    sparse = panel(spark, rows)
    dense = ops.zero_fill(sparse, area="past", default_area="none")
    found = {(r["district"], r["unit"], r["month"]): r["area_mode"] for r in dense.collect()}
    assert len(found) == 4 * 4
    for district in "ABC":
        assert [found[district, "u", month(i)] for i in range(4)] == ["none", "w", "x", "x"]
    assert {found["C", "v", month(i)] for i in range(4)} == {"none"}
    same = ops.zero_fill(sparse)
    assert dense.drop("area_mode").exceptAll(same.drop("area_mode")).count() == 0 and same.count() == 16
    later = panel(spark, [*rows, *[(d, "u", month(3), 1, "q") for d in "DEFGH"]])
    again = ops.zero_fill(later, area="past", default_area="none").filter(F.col("district") == "A").collect()
    assert {r["month"]: r["area_mode"] for r in again} == {month(i): found["A", "u", month(i)] for i in range(4)}
    with pytest.raises(ValueError):
        ops.zero_fill(sparse, area="future")
