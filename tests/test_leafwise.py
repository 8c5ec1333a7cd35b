"""Leaf-wise boosting against a plain version that splits one leaf at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.models import leafwise
from panelcast.models.leafwise import Growth


def score(total, rows, growth):
    return max(abs(total) - growth.l1, 0.0) ** 2 / (rows + growth.l2)


def plain_tree(bins, residual, features, growth):
    """Predictions of one tree: the leaf with the highest gain is split, over and over."""

    def best(rows):
        found = (0.0, None)
        for place, f in enumerate(features):
            for b in range(leafwise.BINS - 1):
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if min(len(left), len(right)) < growth.min_rows:
                    continue
                parts = [(residual[r].sum(), len(r)) for r in (left, right, rows)]
                gain = round(sum(score(*p, growth) for p in parts[:2]) - score(*parts[2], growth), 9)
                if gain > found[0] + 1e-12:
                    found = (gain, (left, right))
        return found

    leaves = [(np.arange(len(bins)), 0)]
    waiting = [(*best(leaves[0][0]), 0)] if growth.depth else []
    done = []
    groups = {0: (np.arange(len(bins)), 0)}
    number = 1
    while waiting and len(groups) < growth.leaves:
        waiting.sort(key=lambda w: (-w[0], w[2]))
        gain, sides, at = waiting.pop(0)
        if not gain > growth.min_gain or sides is None:
            break
        _, depth = groups.pop(at)
        for rows in sides:
            groups[number] = (rows, depth + 1)
            if depth + 1 < growth.depth:
                waiting.append((*best(rows), number))
            number += 1
    out = np.zeros(len(bins))
    for rows, _ in [*groups.values(), *done]:
        total = residual[rows].sum()
        out[rows] = growth.rate * np.sign(total) * max(abs(total) - growth.l1, 0.0) / (len(rows) + growth.l2)
    return out, len(groups)


def data(n=400, seed=3):
    rng = np.random.default_rng(seed)
    columns = np.stack([rng.uniform(0, 6, n), rng.integers(0, 5, n).astype(float), rng.normal(0, 1, n)], axis=1)
    y = 3 * np.sin(columns[:, 0]) * columns[:, 1] + columns[:, 2] + rng.normal(0, 0.3, n)
    return columns, y


@pytest.mark.parametrize(
    "growth",
    [
        Growth(leaves=7, depth=20, min_rows=5, rate=1.0),
        Growth(leaves=12, depth=3, min_rows=5, rate=0.5),
        Growth(leaves=9, depth=9, min_rows=10, l1=4.0, l2=3.0),
        Growth(leaves=6, depth=9, min_rows=3, min_gain=60.0),
        Growth(leaves=1, depth=9),
    ],
)
def test_a_tree_is_the_plain_one(growth):
    columns, y = data()
    bins = leafwise.binned(columns, leafwise.edges_of(columns))
    rest, features = y - y.mean(), np.arange(3)
    tree = leafwise.grow(bins, rest, np.ones(len(y), dtype=bool), features, growth)
    wanted, leaves = plain_tree(bins, rest, features, growth)
    assert tree.feature.count(-1) == leaves <= growth.leaves
    assert np.allclose(tree.predict(bins, "cut"), wanted)


def test_values_and_bins_take_the_same_way():
    columns, y = data(900)
    columns[:, 2] = np.round(columns[:, 2], 1)
    marks = np.arange(len(y))
    forest = leafwise.boost(columns, y, marks, np.zeros(len(y), dtype=bool), Growth(trees=5, leaves=20, min_rows=2))
    bins = leafwise.binned(columns, leafwise.edges_of(columns))
    assert np.allclose(forest.predict(columns), forest.predict(bins, "cut"))
    assert forest.gains().sum() == pytest.approx(1)


def test_penalties_shrink_leaves():
    columns, y = data()
    none = np.zeros(len(y), dtype=bool)
    spread = [
        np.std(leafwise.boost(columns, y, np.arange(len(y)), none, Growth(trees=1, rate=1.0, l1=l1, l2=l2)).predict(columns))
        for l1, l2 in ((0, 0), (20, 0), (0, 50))
    ]
    assert spread[1] < spread[0] and spread[2] < spread[0]
    assert leafwise.leaf_value(np.array([5.0, -5.0, 0.5]), np.array([2.0, 2.0, 2.0]), 1.0, 2.0).tolist() == [1.0, -1.0, 0.0]


def test_patience_keeps_the_best_trees():
    columns, y = data(600)
    held = np.arange(len(y)) % 3 == 0
    growth = Growth(trees=400, rate=0.3, leaves=31, min_rows=2, patience=15)
    forest = leafwise.boost(columns, y, np.arange(len(y)), held, growth)
    assert len(forest.errors) < 400 and len(forest.errors) == len(forest.trees) + 15
    assert forest.errors[len(forest.trees) - 1] == min(forest.errors)
    rest = ((y - forest.predict(columns))[held] ** 2).mean()
    assert rest == pytest.approx(min(forest.errors))


def frame(spark, columns, y):
    rows = [(*map(float, c), float(v)) for c, v in zip(columns, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double")


def test_rows_may_be_dealt_out_in_any_way(spark, tmp_path):
    columns, y = data(300)
    df = frame(spark, columns, y)
    growth = Growth(trees=12, leaves=8, min_rows=5)
    one, other = (leafwise.fit(df.repartition(n), ["a", "b", "c"], "y", growth) for n in (1, 7))
    assert one == other
    leafwise.write(spark, one, str(tmp_path / "f"))
    assert leafwise.read(spark, str(tmp_path / "f")) == one
    got = leafwise.with_prediction(df, one, ["a", "b", "c"]).orderBy("a").toPandas()
    assert np.allclose(got.prediction, one.predict(got[["a", "b", "c"]].to_numpy()))


def test_more_rows_than_a_model_learns_from(spark):
    """The share that is left does not depend on the deal, and every row is scored."""
    columns, y = data(2000)
    df = frame(spark, columns, y)
    forest = leafwise.fit(df, ["a", "b", "c"], "y", Growth(trees=40, rate=0.2, leaves=15), most=500)
    scored = leafwise.with_prediction(df, forest, ["a", "b", "c"])
    assert scored.count() == 2000
    error = scored.agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert error < 0.5 * np.var(y)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "a double, y double")
    forest = leafwise.fit(empty, ["a"], "y", Growth())
    assert forest.trees == [] and forest.predict(np.zeros((2, 1))).tolist() == [0.0, 0.0]
