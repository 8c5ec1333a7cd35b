"""Models, metrics and the recursive forecast against plain arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import column, month, panel, series
from panelcast.functions import metrics, numeric, text
from panelcast.models import blend, forecast, leafwise, naive, ridge, trees
from panelcast.operators import extended, features, reports, split


@pytest.fixture(scope="module")
def table(spark):
    parts = [
        series([(7 * i + 3 * k * i) % 13 + k for i in range(60)], unit=f"u{k}", area="Cível" if k % 2 else "x")
        for k in range(6)
    ]
    return split.drop_warmup(features.add_base_features(panel(spark, *parts))).cache()


def normal_equations(rows, penalty):
    x = np.array([[float(r[c]) for c in features.BASE_FEATURES] for r in rows])
    y = np.array([float(r["y"]) for r in rows])
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)
    design = np.hstack([np.ones((len(z), 1)), z])
    ridge_matrix = penalty * np.eye(design.shape[1])
    ridge_matrix[0, 0] = 0
    return np.linalg.solve(design.T @ design + ridge_matrix, design.T @ y), design, y


def test_ridge_equals_dense_solution(table):
    model = ridge.fit_ridge(table)
    beta, design, _ = normal_equations(table.collect(), ridge.PENALTY)
    assert np.allclose(model.beta, beta, atol=1e-6)
    predicted = table.select(model.forecast().alias("p"), *features.BASE_FEATURES).collect()
    assert np.allclose([r["p"] for r in predicted], np.maximum(design @ beta, 0), atol=1e-6)


def test_ridge_round_trip(spark, table, tmp_path):
    model = ridge.fit_ridge(table)
    model.save(spark, str(tmp_path / "model"))
    assert ridge.RidgeModel.load(spark, str(tmp_path / "model")) == model
    shares = model.importance(spark).agg(F.sum("importance")).first()[0]
    assert shares == pytest.approx(100, abs=0.2)


def test_published_model_on_a_fixture_row(spark):
    values = dict.fromkeys(features.BASE_FEATURES, 0.0) | {"lag_1": 100.0, "month_of_year": 6.0}
    row = spark.createDataFrame([values])
    expected = ridge.PUBLISHED.beta[0] + sum(
        (values[c] - m) / (s + 1e-8) * b
        for c, m, s, b in zip(features.BASE_FEATURES, ridge.PUBLISHED.means, ridge.PUBLISHED.stds, ridge.PUBLISHED.beta[1:])
    )
    assert row.select(ridge.PUBLISHED.forecast()).first()[0] == pytest.approx(max(expected, 0))


def test_blend_ends(spark):
    df = spark.createDataFrame([(1.0, 5.0, 3)], "a double, b double, y long")
    ends = [df.select(blend.blend_forecast(F.col("a"), F.col("b"), w)).first()[0] for w in (0.0, 1.0)]
    assert ends == [5.0, 1.0]


def test_alpha_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3)], "a double, b double, y long")
    assert blend.best_alpha(blend.alpha_curve(df, "a", "b")).first()["alpha"] == 0.0


def test_alpha_finds_the_better_model(spark):
    df = spark.createDataFrame([(3.0, 9.0, 3), (5.0, 0.0, 5)], "a double, b double, y long")
    best = blend.best_alpha(blend.alpha_curve(df, "a", "b")).first()
    assert (best["alpha"], best["score"]) == (1.0, 0.0)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 3.0), (5, 1.0)], "y long, p double")
    y, p = F.col("y"), F.col("p")
    row = df.agg(metrics.mae(y, p), metrics.rmse(y, p), metrics.wmape(y, p), metrics.r2(y, p)).first()
    assert list(row) == pytest.approx([5 / 3, math.sqrt(17 / 3), 500 / 9, 1 - 17 / 8])


def test_all_zero_actuals(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 0.0)], "y long, p double")
    y, p = F.col("y"), F.col("p")
    row = df.agg(metrics.wmape(y, p), metrics.wmape(y, p, on_zero=0), metrics.r2(y, p)).first()
    assert list(row) == [None, 0.0, 0.0]


def test_rounding_and_bands(spark):
    df = spark.createDataFrame([(0.5, 100), (1.5, 0), (2.5, None)], "x double, p long")
    rows = df.select(
        numeric.half_even(F.col("x")), numeric.band_low(F.col("p"), 0.15), numeric.band_high(F.col("p"), 0.15)
    ).collect()
    assert [list(r) for r in rows] == [[0.0, 85, 114], [2.0, 0, 0], [2.0, None, None]]


def test_not_negative_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(numeric.not_negative(F.col("x"))).collect()] == [0.0, 2.0, None]


def test_accuracy_classes(spark):
    df = spark.createDataFrame([(19.9,), (20.0,), (34.9,), (35.0,)], "w double")
    assert [r[0] for r in df.select(numeric.accuracy_band(F.col("w"))).collect()] == ["<20", "20-35", "20-35", ">35"]


def test_histogram_of_equal_residuals(spark):
    df = spark.createDataFrame([(3, 1.0), (4, 2.0)], "y long, p double")
    rows = [tuple(r) for r in reports.residual_histogram(df, "p").orderBy("bin").collect()]
    assert len(rows) == reports.RESIDUAL_BINS
    assert rows[0] == (1, 2.0, 2.0, 2) and all(r[3] == 0 for r in rows[1:])


def test_title_case(spark):
    df = spark.createDataFrame([("SANT'ANA DO-RIO",), ("são joão 2a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.title_case(F.col("t"))).collect()] == ["Sant'Ana Do-Rio", "São João 2A", "", None]


def test_category_align(spark):
    train = spark.createDataFrame([("A", "u")], "district string, unit string")
    rows = spark.createDataFrame([("A", "new")], "district string, unit string")
    assert tuple(trees.align_categories(rows, train, ["district", "unit"]).select("district", "unit").first()) == (
        "A",
        "unknown",
    )


def test_naive_recursion_repeats_the_year(spark):
    df = panel(spark, series(list(range(20))))
    ahead = forecast.forecast_naive(df, horizon=14)
    assert column(ahead, "forecast") == [*range(8, 20), 8, 9]
    assert column(ahead, "month")[0] == month(20)


def test_naive_without_a_year_of_history(spark):
    ahead = forecast.forecast_naive(panel(spark, series([5, 6])), horizon=12)
    assert column(ahead, "value") == [None] * 10 + [5, 6]


def test_ridge_recursion_equals_step_by_step(spark, table):
    """The array recursion against features rebuilt on the growing panel every month."""
    model = ridge.fit_ridge(table)
    rules = features.CalendarRules()
    history = table.select("district", "unit", "month", "y", "area_mode")
    got = forecast.forecast_ridge(history, model, rules, horizon=3)
    grown = history.withColumn("y", F.col("y").cast("double"))
    for _ in range(3):
        last = grown.agg(F.max("month")).first()[0]
        new = grown.filter(F.col("month") == last).withColumns(
            {"month": F.add_months("month", 1), "y": F.lit(None).cast("double")}
        )
        added = features.add_base_features(grown.unionByName(new), rules=features.CalendarRules(flag_years=()))
        filled = added.filter(F.col("month") > last).withColumn("y", model.forecast())
        grown = spark.createDataFrame(grown.unionByName(filled.select(*grown.columns)).collect(), grown.schema)
    expected = grown.filter(F.col("month") > history.agg(F.max("month")).first()[0])
    assert np.allclose(column(got, "value", digits=9), column(expected, "y", digits=9), atol=1e-6)


SMALL_TREES = trees.TreeParams(trees=5, rate=0.3, depth=3, min_rows=1)


def test_trees_beat_nothing_and_keep_unseen_rows(spark, table):
    model = trees.fit_trees(table, features.BASE_FEATURES, params=SMALL_TREES)
    unseen = table.limit(3).withColumn("unit", F.lit("never seen"))
    assert model.predict(unseen).filter(F.col("forecast") >= 0).count() == 3
    y = F.col("y")
    spread = table.agg(F.stddev_pop("y")).first()[0]
    assert model.predict(table).agg(metrics.rmse(y, F.col("forecast"))).first()[0] < spread
    assert model.importance(spark).agg(F.sum("importance")).first()[0] == pytest.approx(1)


def test_categories_are_means_of_other_folds(spark):
    rows = [("a", f"u{i % 7}", float(i % 5)) for i in range(60)] + [("b", "u1", 9.0)]
    df = spark.createDataFrame(rows, "district string, unit string, y double").withColumn("fold", trees.fold_of(["district", "unit"]))
    found = {(r["district"], r["fold"]): r["district_level"] for r in trees.fold_levels(df, "district", 2.0, ["district", "unit"]).collect()}
    assert len(found) == 2 * trees.FOLDS
    for (district, fold), level in found.items():
        rest = [r["y"] for r in df.collect() if r["district"] == district and r["fold"] != fold]
        assert level == pytest.approx((sum(rest) + trees.SMOOTHING * 2.0) / (len(rest) + trees.SMOOTHING))


def test_patience():
    assert leafwise.first_minimum([5, 4, 4, 3, 9, 9, 9], 3) == (3, True)
    assert leafwise.first_minimum([5, 4, 4, 3, 9, 9], 3) == (3, False)
    assert leafwise.first_minimum([5, 6, 6, 1], 2) == (0, True)


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        a, b = rng.uniform(0, 6, 2)
        rows.append((float(a), float(b), f"d{i % 9}", f"u{i % 4}", float(3 * np.sin(a) * b + i % 9 + rng.normal(0, 0.3)), i % 3 == 0))
    return spark.createDataFrame(rows, "a double, b double, district string, unit string, y double, held boolean")


def test_boosting_goes_on_while_it_helps(spark, signal, tmp_path):
    """More trees than one are kept, new categories in validation do not matter, a stored model predicts alike."""
    params = trees.TreeParams(trees=120, rate=0.05, depth=4, min_rows=3, patience=30)
    held = signal.filter("held").withColumn("district", F.when(F.col("a") > 5, F.lit("new")).otherwise(F.col("district")))
    model = trees.fit_trees(signal.filter("not held"), ["a", "b"], params=params, validation=held)
    assert len(model.forest.trees) > 30
    model.save(str(tmp_path / "m"))
    loaded = trees.TreeModel.load(spark, str(tmp_path / "m"))
    assert loaded.inputs == model.inputs
    both = [sorted(round(r["forecast"], 9) for r in m.predict(held).select("forecast").collect()) for m in (model, loaded)]
    assert both[0] == both[1]


@pytest.mark.parametrize("wide", [False, True])
def test_tree_recursion(spark, table, wide):
    history = table.select("district", "unit", "month", "y", "area_mode")
    numeric_features = extended.NUMERIC_FEATURES if wide else features.BASE_FEATURES
    rows = extended.zero_nulls(extended.add_all_features(history), numeric_features) if wide else table
    model = trees.fit_trees(rows, numeric_features, params=SMALL_TREES)
    ahead = forecast.forecast_trees(history, model, horizon=2, extended=wide)
    assert ahead.count() == 6 * 2
    assert ahead.filter(F.col("value").isNull() | (F.col("value") < 0)).count() == 0


def test_naive_forecast_is_lag_twelve(table):
    rows = table.select(naive.naive_forecast().alias("p"), "lag_12").collect()
    assert all(r["p"] == r["lag_12"] for r in rows)


def test_moments_of_ill_scaled_columns(spark):
    """One pass equals two passes where means are far above deviations, whatever the partitions."""
    rng = np.random.default_rng(5)
    data = np.column_stack([rng.normal(1e7, 1e-1, 3000), rng.normal(-3e4, 2.0, 3000), rng.normal(0, 1e5, 3000), np.full(3000, 7.0)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, c double, y double")
    centred = data - data.mean(axis=0)
    for parts in (1, 7, 70):
        row = ridge.moments(df.repartition(parts), ["a", "b", "c", "y"]).first()
        assert row["n"] == 3000 and np.allclose(row["mean"], data.mean(axis=0), rtol=1e-14)
        found = np.array(row["scatter"]).reshape(4, 4)
        scale = np.sqrt(np.outer(np.diag(centred.T @ centred) + 1, np.diag(centred.T @ centred) + 1))
        assert np.abs((found - centred.T @ centred) / scale).max() < 1e-9


def test_normal_equations_with_given_scales(spark):
    data = np.random.default_rng(6).normal(5, 2, (200, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "a double, b double, y double").repartition(3)
    scales = {"a": (1.0, 2.0), "b": (-3.0, 0.5)}
    design = np.column_stack([np.ones(200), (data[:, 0] - 1) / (2 + 1e-8), (data[:, 1] + 3) / (0.5 + 1e-8), data[:, 2]])
    names = ["bias", "a", "b", "y"]
    found = {(r["row"], r["col"]): r["value"] for r in ridge.gram_matrix(df, ["a", "b"], "y", scales).collect()}
    whole = design.T @ design
    assert len(found) == 9
    assert all(abs(v - whole[names.index(a), names.index(b)]) < 1e-8 * abs(v) for (a, b), v in found.items())


def test_no_rows_have_no_moments(spark):
    df = spark.createDataFrame([], "a double, y double")
    assert ridge.moments(df, ["a", "y"]).collect() == ridge.gram_matrix(df, ["a"], "y").collect() == []
    with pytest.raises(ValueError):
        ridge.fit_ridge(df, ["a"], "y")
