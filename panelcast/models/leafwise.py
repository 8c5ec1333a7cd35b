"""Boosted regression trees that grow leaf by leaf, with L1 and L2 penalties.

Rows are binned to a byte per feature. Sums of residuals and numbers of rows by (leaf, feature, bin) decide each
split. A tree splits the leaf with the highest gain first, until it has its leaves or no split gains
anything. The children of all leaves that may come next are summed up together; what best-first
order would not have split is then left whole. Trees grow on while the validation error falls.

A model is grown by one task from at most ``ROWS`` rows, so its time and memory are bounded whatever the
size of the table; beyond that a hash of the rows chooses them. Scoring is spread over all tasks and
sees every row.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

#: Bins of a feature at most; a byte holds one.
BINS = 64
#: Rows at most, about, that a model learns from, and as many that it is validated on.
ROWS = 1_000_000


@dataclass(frozen=True)
class Growth:
    """``leaves``: at most, ``depth``: at most; ``l1``, ``l2``: penalties on a leaf's value; ``min_rows``: of a leaf.

    ``row_share`` of the rows (drawn per tree) and ``feature_share`` of the features take part in a tree. ``patience``:
    trees without a lower validation error after which growth ends.
    """

    trees: int = 300
    rate: float = 0.05
    leaves: int = 63
    depth: int = 8
    row_share: float = 0.8
    feature_share: float = 0.8
    l1: float = 0.0
    l2: float = 0.0
    min_rows: int = 20
    min_gain: float = 0.0
    seed: int = 42
    patience: int = 30


@dataclass
class Tree:
    """Nodes in order of creation; ``feature`` is -1 at leaves. Rows with ``value <= threshold`` go left."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, start in (("feature", -1), ("threshold", 0.0), ("cut", 0), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0)):
            getattr(self, name).append(start)
        return len(self.value) - 1

    def apply(self, columns: np.ndarray, by: str = "threshold") -> np.ndarray:
        """The leaf of each row of ``columns`` (rows x features): raw values, or bins with ``by='cut'``."""
        feature, left, right = (np.array(getattr(self, n)) for n in ("feature", "left", "right"))
        limit = np.array(getattr(self, by))
        node = np.zeros(len(columns), dtype=np.int64)
        rows = np.arange(len(columns))
        while len(rows):
            at = node[rows]
            inner = feature[at] >= 0
            rows, at = rows[inner], at[inner]
            goes = columns[rows, feature[at]] <= limit[at]
            node[rows] = np.where(goes, left[at], right[at])
        return node

    def predict(self, columns: np.ndarray, by: str = "threshold") -> np.ndarray:
        return np.array(self.value)[self.apply(columns, by)]


# --- sums and decisions -----------------------------------------------------


def leaf_value(total: np.ndarray, rows: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The best step of a leaf with this sum of residuals: L1 pulls the sum to zero, L2 adds to the rows."""
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0.0) / np.maximum(rows + l2, 1e-12)


def leaf_score(total: np.ndarray, rows: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return np.maximum(np.abs(total) - l1, 0.0) ** 2 / np.maximum(rows + l2, 1e-12)


def sums_of(bins: np.ndarray, residual: np.ndarray, group: np.ndarray, groups: int, features: np.ndarray) -> np.ndarray:
    """Sums of residuals and numbers of rows, by (group, feature, bin). Rows of group -1 are left out."""
    found = np.zeros((2, groups, len(features), BINS))
    inside = np.flatnonzero(group >= 0)
    base, own, weights = group[inside] * BINS, bins[inside], residual[inside]
    for i, f in enumerate(features):
        place = base + own[:, f]
        found[0, :, i] = np.bincount(place, weights, minlength=groups * BINS).reshape(groups, BINS)
        found[1, :, i] = np.bincount(place, minlength=groups * BINS).reshape(groups, BINS)
    return found


def best_splits(sums: np.ndarray, growth: Growth) -> list[tuple[float, int, int, np.ndarray]]:
    """Per group: gain, place of the feature, last bin of the left side, sums of both sides."""
    total, rows = sums[0].sum(axis=2)[:, :1], sums[1].sum(axis=2)[:, :1]
    left, left_n = np.cumsum(sums[0], axis=2)[:, :, :-1], np.cumsum(sums[1], axis=2)[:, :, :-1]
    right, right_n = total[:, :, None] - left, rows[:, :, None] - left_n
    gain = leaf_score(left, left_n, growth.l1, growth.l2) + leaf_score(right, right_n, growth.l1, growth.l2)
    gain -= leaf_score(total, rows, growth.l1, growth.l2)[:, :, None]
    gain[(left_n < growth.min_rows) | (right_n < growth.min_rows)] = -np.inf
    # Sums in another order differ in their last digits; equal gains go to the first feature and bin.
    flat = np.round(gain, 9).reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    found = []
    for i, place in enumerate(best.tolist()):
        f, b = divmod(place, BINS - 1)
        sides = np.array([[left[i, f, b], left_n[i, f, b]], [right[i, f, b], right_n[i, f, b]]])
        found.append((float(flat[i, place]), f, b, sides))
    return found


def grow(bins: np.ndarray, residual: np.ndarray, chosen: np.ndarray, features: np.ndarray, growth: Growth) -> Tree:
    """One tree on the rows that ``chosen`` marks, without thresholds."""
    group = np.where(chosen, 0, -1)
    whole = sums_of(bins, residual, group, 1, features)
    start = whole[:, 0, 0].sum(axis=1)
    if not start[1]:
        tree = Tree()
        tree.add(0.0)
        return tree
    # Candidates: sums, depth, split; a candidate's children are known once it is opened.
    nodes = [{"sides": start, "depth": 0, "split": best_splits(whole, growth)[0], "children": None}]
    where = group.copy()

    def order() -> tuple[list[int], list[int]]:
        """Best-first order as far as the opened candidates tell: splits so far, and what has to be opened next."""
        heap = [(-nodes[0]["split"][0], 0)]
        taken: list[int] = []
        while heap and len(taken) < growth.leaves - 1:
            if not -heap[0][0] > growth.min_gain:
                break
            at = heap[0][1]
            if nodes[at]["children"] is None:
                break
            heapq.heappop(heap)
            taken.append(at)
            for child in nodes[at]["children"]:
                if nodes[child]["depth"] < growth.depth:
                    heapq.heappush(heap, (-nodes[child]["split"][0], child))
        else:
            return taken, []
        if not heap or not -heap[0][0] > growth.min_gain:
            return taken, []
        room = growth.leaves - 1 - len(taken)
        waiting = [(gain, at) for gain, at in sorted(heap) if nodes[at]["children"] is None and -gain > growth.min_gain]
        return taken, [at for _, at in waiting[:room]]

    while True:
        taken, wanted = order()
        if not wanted:
            break
        # The smaller child is summed up, the other one's sums are what is left of the parent's.
        smaller = []
        for k, at in enumerate(wanted):
            gain, f, b, sides = nodes[at]["split"]
            side = int(sides[1, 1] < sides[0, 1])
            rows = np.flatnonzero(where == at)
            left = bins[rows, features[f]] <= b
            first = len(nodes)
            nodes += [{"sides": sides[i], "depth": nodes[at]["depth"] + 1, "split": (-np.inf, 0, 0, sides), "children": None} for i in (0, 1)]
            nodes[at]["children"] = (first, first + 1)
            where[rows] = np.where(left, first, first + 1)
            smaller.append(first + side)
        # A child at the last depth is never split, so it needs no sums.
        open_ = [at for at in smaller if nodes[at]["depth"] < growth.depth]
        if not open_:
            continue
        fresh = np.full(len(nodes), -1)
        fresh[open_] = np.arange(len(open_))
        inside = np.where(where >= 0, fresh[where], -1)
        sums = sums_of(bins, residual, inside, len(open_), features)
        for i, at in enumerate(open_):
            parent = next(p for p in wanted if at in nodes[p]["children"])
            other = sum(nodes[parent]["children"]) - at
            nodes[at]["sums"] = sums[:, i]
            nodes[other]["sums"] = (whole[:, 0] if parent == 0 else nodes[parent]["sums"]) - sums[:, i]
            for child, split in zip((at, other), best_splits(np.stack([nodes[at]["sums"], nodes[other]["sums"]], axis=1), growth)):
                nodes[child]["split"] = split
        for parent in wanted:
            nodes[parent].pop("sums", None)

    tree = Tree()
    number = {0: tree.add(0.0)}
    for at in taken:
        gain, f, b, _ = nodes[at]["split"]
        own = number[at]
        tree.feature[own], tree.cut[own], tree.gain[own] = int(features[f]), int(b), gain
        for side, child in zip(("left", "right"), nodes[at]["children"]):
            number[child] = tree.add(0.0)
            getattr(tree, side)[own] = number[child]
    for at, own in number.items():
        if tree.feature[own] < 0:
            total, rows = nodes[at]["sides"]
            tree.value[own] = growth.rate * float(leaf_value(total, rows, growth.l1, growth.l2))
    return tree


def drawn(marks: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
    """Rows that take part in a tree, by a hash of the row: alike however the rows are dealt out."""
    x = marks.astype(np.uint64) ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + seed & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * ((1 << 64) - 1)))


def drawn_features(n: int, tree: int, growth: Growth) -> np.ndarray:
    count = max(1, round(growth.feature_share * n))
    return np.sort(np.random.default_rng((growth.seed, tree)).permutation(n)[:count])


# --- fitting ----------------------------------------------------------------


@dataclass
class Forest:
    """A constant and trees. ``errors``: mean squared validation error after each tree that was grown."""

    base: float
    trees: list[Tree]
    features: int
    errors: list[float] = field(default_factory=list)

    def predict(self, columns: np.ndarray, by: str = "threshold") -> np.ndarray:
        found = np.full(len(columns), self.base)
        for tree in self.trees:
            found += tree.predict(columns, by)
        return found

    def gains(self) -> np.ndarray:
        """Share of the total gain per feature."""
        total = np.zeros(self.features)
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] += gain
        return total / total.sum() if total.sum() > 0 else total

    def to_json(self) -> str:
        return json.dumps({"base": self.base, "features": self.features, "errors": self.errors, "trees": [vars(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> Forest:
        data = json.loads(text)
        return cls(data["base"], [Tree(**t) for t in data["trees"]], data["features"], data["errors"])


def edges_of(columns: np.ndarray) -> list[np.ndarray]:
    """Upper limits of each feature's bins; the last bin is open. A feature with few values gets a bin for each."""
    found = []
    for values in np.sort(columns, axis=0).T:
        distinct = values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values
        if len(distinct) <= BINS:
            found.append((distinct[:-1] + distinct[1:]) / 2)
        else:
            at = np.quantile(values, np.arange(1, BINS) / BINS, method="inverted_cdf")
            found.append(at[np.concatenate([[True], at[1:] != at[:-1]])])
    return found


def binned(columns: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A byte per value: the first bin whose limit is not below it."""
    return np.stack([np.searchsorted(e, columns[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    columns = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]
    return np.stack(columns, axis=1) if len(columns) else np.zeros((batch.num_rows, 0))


def boost(columns: np.ndarray, y: np.ndarray, marks: np.ndarray, held: np.ndarray, growth: Growth) -> Forest:
    """Trees on the rows that are not ``held``, as many as lower the error on the held ones within the patience."""
    edges = edges_of(columns[~held])
    bins = binned(columns, edges)
    forest = Forest(float(y[~held].mean()) if (~held).any() else 0.0, [], columns.shape[1])
    rest = y - forest.base
    for number in range(growth.trees):
        chosen = ~held & drawn(marks, number, growth.row_share, growth.seed)
        tree = grow(bins, rest, chosen, drawn_features(columns.shape[1], number, growth), growth)
        tree.threshold = [float(edges[f][c]) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
        rest = rest - tree.predict(bins, "cut")
        forest.trees.append(tree)
        if held.any():
            forest.errors.append(float((rest[held] ** 2).mean()))
            if first_minimum(forest.errors, growth.patience)[1]:
                break
    if held.any() and forest.errors:
        forest.trees = forest.trees[: first_minimum(forest.errors, growth.patience)[0] + 1]
    return forest


def first_minimum(errors: list[float], patience: int) -> tuple[int, bool]:
    """Place of the lowest error before ``patience`` values in a row are no lower, and whether that happened."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """All rows, or those whose marks are small enough that about ``most`` are left."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.col("_mark"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def fit(rows: DataFrame, features: list[str], target: str, growth: Growth, validation: DataFrame | None = None, most: int = ROWS) -> Forest:
    """Grow trees on ``rows``; with ``validation`` as many as lower the error there, within the patience.

    Null features and targets are not allowed. The result does not depend on how rows are dealt out.
    """
    mark = F.xxhash64(*features, target).alias("_mark")
    numbers = [F.col(c).cast("double").alias(c) for c in (*features, target)]
    both = _bounded(rows.select(*numbers, mark, F.lit(False).alias("_held")), most)
    if validation is not None:
        both = both.unionByName(_bounded(validation.select(*numbers, mark, F.lit(True).alias("_held")), most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(matrix(b, [*features, target]), *[matrix(b, [c])[:, 0] for c in ("_held",)], b.column(b.schema.get_field_index("_mark")).to_numpy()) for b in batches]
        if not parts:
            return
        whole, held, marks = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((*whole.T, marks))
        whole, held, marks = whole[order], held[order] > 0, marks[order]
        forest = boost(whole[:, :-1], whole[:, -1], marks, held, growth)
        yield pa.RecordBatch.from_pydict({"forest": [forest.to_json()]})

    done = both.repartition(1).mapInArrow(run, "forest string").collect()
    return Forest.from_json(done[0]["forest"]) if done else Forest(0.0, [], len(features))


def with_prediction(df: DataFrame, forest: Forest, features: list[str], name: str = "prediction") -> DataFrame:
    """``df`` with the forest's prediction as a column."""
    shared = df.sparkSession.sparkContext.broadcast(forest.to_json())

    @pandas_udf("double")
    def predict(*columns):
        import pandas as pd

        known = _loaded(shared.value)
        values = np.stack([c.to_numpy(dtype=np.float64) for c in columns], axis=1)
        return pd.Series(known.predict(values))

    return df.withColumn(name, predict(*[F.col(f).cast("double") for f in features]))


_kept: dict[int, Forest] = {}


def _loaded(text: str) -> Forest:
    """The forest of a task's batches, read once."""
    key = hash(text)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Forest.from_json(text)
    return _kept[key]


def read(spark: SparkSession, path: str) -> Forest:
    return Forest.from_json(spark.read.text(path, wholetext=True).first()[0])


def write(spark: SparkSession, forest: Forest, path: str) -> None:
    spark.createDataFrame([(forest.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
