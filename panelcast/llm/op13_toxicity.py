"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams it holds. Over all labelled texts Spark counts how
many toxic and how many other texts hold each feature; the logarithm of the ratio of both smoothed
shares is the feature's scale. A logistic regression on the scaled features is fitted on a
bounded sample, so each feature's weight is its ratio times what the regression makes of it.

Texts are read in windows of so many characters, and a text is as toxic as its most toxic window: an insult
weighs as much in a long text as in a short one. The regression learns windows the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.flat import Flat, draw, positions

#: Lengths of the n-grams in bytes; the marks of word ends count.
SIZES = (4, 5, 6)
BUCKETS = 1 << 18
#: Texts without news that are added to every feature's counts, toxic and clean in the proportion of all.
SMOOTHING = 10.0
#: Windows of a text: bytes, and how many the next one starts later.
WINDOW = 64
STRIDE = 32
#: Labelled texts of each class at most that the regression is fitted on, by the hashes of their keys.
#: Counts of features come from all labelled texts.
SAMPLE = 1500
#: Windows at most that one text of the sample brings to the driver; scoring reads all windows of every text.
SAMPLE_WINDOWS = 16
#: One in so many labelled texts is kept from counts and regression to calibrate the score, and so many of a class at most.
CALIBRATION = 5
CALIBRATION_SAMPLE = 1500
ROUNDS = 6
STEPS = 60
RIDGE = 0.1
LIMIT = 0.5
SLICE_BYTES = 1 << 19

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_FOLDED[[i for i in range(128) if not chr(i).isalnum()]] = 32


class Windows:
    """Windows of each text of a batch: ``texts[w]`` owns window ``w``. Features are n-grams at byte positions."""

    def __init__(self, texts: pa.Array):
        flat = Flat.of(texts)
        self.codes = _FOLDED[flat.data].astype(np.uint64)
        self.rows, self.bounds = flat.rows, flat.bounds
        sizes = np.diff(flat.bounds)
        count = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
        self.texts = np.repeat(np.arange(flat.rows), count)
        place = np.arange(len(self.texts)) - np.repeat(np.cumsum(count) - count, count)
        self.starts = flat.bounds[:-1][self.texts] + place * STRIDE
        self.lengths = np.minimum(WINDOW, flat.bounds[1:][self.texts] - self.starts)

    def features(self, size: int) -> np.ndarray:
        """The feature that begins at each byte, for n-grams of one size."""
        joined = np.zeros(max(0, len(self.codes) - size + 1), dtype=np.uint64)
        for k in range(size):
            joined |= self.codes[k : k + len(joined)] << np.uint64(8 * k)
        return (draw(joined, size) & np.uint64(BUCKETS - 1)).astype(np.int64)

    def by_text(self) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and distinct features of whole texts."""
        sizes, keys = np.diff(self.bounds), []
        for size in SIZES:
            own = np.maximum(sizes - size + 1, 0)
            keys.append(np.repeat(np.arange(self.rows) * BUCKETS, own) + self.features(size)[positions(self.bounds[:-1], own)])
        keys = np.concatenate(keys)
        # Half the bytes sort in half the time.
        keys = np.sort(keys.astype(np.uint32) if self.rows * BUCKETS < 1 << 32 else keys)
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        return (keys // BUCKETS).astype(np.int64), (keys % BUCKETS).astype(np.int64)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each window's features over the root of their number."""
        total, count = np.zeros(len(self.starts)), np.zeros(len(self.starts))
        for size in SIZES:
            own = np.maximum(self.lengths - size + 1, 0)
            before = np.concatenate([[0.0], np.cumsum(weights[self.features(size)])])
            at = np.minimum(self.starts, len(before) - 1)
            # Whole multiples of 2^-20 add up without error, so equal windows have equal sums wherever they stand.
            total += before[np.minimum(at + own, len(before) - 1)] - before[at]
            count += own
        return total / np.sqrt(np.maximum(count, 1))

    def bags(self, chosen: np.ndarray) -> list[bytes]:
        """Features of the chosen windows, as often as they occur, packed."""
        whole = {size: self.features(size).astype("<i4") for size in SIZES}
        return [
            b"".join(whole[size][start : start + max(0, length - size + 1)].tobytes() for size in SIZES)
            for start, length in zip(self.starts[chosen].tolist(), self.lengths[chosen].tolist())
        ]

    def greatest(self, values: np.ndarray) -> np.ndarray:
        """Per text, the greatest value of its windows."""
        return np.maximum.reduceat(values, np.searchsorted(self.texts, np.arange(self.rows))) if self.rows else values


def grid(weights: np.ndarray) -> np.ndarray:
    """Weights rounded to multiples of 2^-20."""
    return np.round(weights * (1 << 20)) / (1 << 20)


@dataclass
class Model:
    """``weights``: one per feature, its log-count ratio included; ``slope``, ``shift``: from sums to probabilities."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, texts: pa.Array) -> np.ndarray:
        windows = Windows(texts)
        return windows.greatest(windows.sums(self.weights)) + self.bias

    def score(self, texts: pa.Array) -> np.ndarray:
        return _logistic(self.slope * self.raw(texts) + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0)))


def log_count_ratios(labelled: DataFrame) -> np.ndarray:
    """Per feature, the logarithm of (share of toxic texts with it) / (share of others), of all rows of ``text``, ``label``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in common.slices(batches, "text", SLICE_BYTES):
            toxic = (common.values(batch, "label").to_numpy() >= 0.5).astype(np.int64)
            owners, features = Windows(common.values(batch, "text")).by_text()
            for side in (0, 1):
                counts[side, :-1] += np.bincount(features[toxic[owners] == side], minlength=BUCKETS)
                counts[side, -1] += int((toxic == side).sum())
        held = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({"feature": held, "clean": counts[0, held], "toxic": counts[1, held]})

    parts = labelled.select("text", "label").mapInArrow(run, "feature long, clean long, toxic long")
    table = parts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, BUCKETS + 1))
    place = table["feature"].to_numpy()
    counts[0, place], counts[1, place] = table["clean"].to_numpy(), table["toxic"].to_numpy()
    texts = counts[:, -1:]
    news = SMOOTHING * texts / texts.sum()
    shares = (counts[:, :-1] + news) / (texts + news)
    return grid(np.log(shares[1] / shares[0]))


def _sampled(labelled: DataFrame, rows_per_class: int, seed: int) -> DataFrame:
    """At most so many rows of each class: the ones with the smallest hashes of their keys."""
    order = [F.xxhash64(F.col("key"), F.lit(seed)), F.col("key")]
    ids = labelled.select("key", "label").distinct()
    some = [ids.where(side).orderBy(*order).limit(rows_per_class) for side in ("label >= 0.5", "label < 0.5")]
    return some[0].unionByName(some[1]).select("key", F.lit(True).alias("chosen"))


def _windows_of(rows: DataFrame, ratios: np.ndarray) -> pa.Table:
    """The windows of the sample's texts with the greatest sums of ratios: key, label, features (packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", SLICE_BYTES):
            windows = Windows(common.values(batch, "text"))
            sums = windows.sums(ratios)
            order = np.lexsort((-sums, windows.texts))
            rank = np.arange(len(order)) - np.searchsorted(windows.texts, windows.texts)
            chosen = np.sort(order[rank < SAMPLE_WINDOWS])
            packed = windows.bags(chosen)
            own = pa.array(windows.texts[chosen])
            yield pa.RecordBatch.from_arrays(
                [common.values(batch, "key").take(own), common.values(batch, "label").take(own), pa.array(packed, pa.binary())],
                names=["key", "label", "features"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, label double, features binary").toArrow().sort_by([("key", "ascending")])


class _Bags:
    """Windows of several texts as one sparse matrix with scaled entries."""

    def __init__(self, table: pa.Table, ratios: np.ndarray):
        packed = table["features"].to_pylist()
        sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
        self.features = np.frombuffer(b"".join(packed), dtype="<i4").astype(np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.values = ratios[self.features] / np.sqrt(np.maximum(sizes, 1))[self.owner]
        keys = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        self.first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        self.labels = (table["label"].to_numpy() >= 0.5)[self.first].astype(np.float64)
        self.windows = len(sizes)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.values * weights[self.features], minlength=self.windows)

    def best(self, weights: np.ndarray) -> np.ndarray:
        """The window of each text that the weights find most toxic; the first of equals."""
        sums = self.sums(weights)
        sizes = np.diff(np.append(self.first, self.windows))
        top = np.repeat(np.maximum.reduceat(sums, self.first), sizes)
        hits = np.flatnonzero(sums == top)
        owner = np.repeat(np.arange(len(sizes)), sizes)[hits]
        return hits[np.concatenate([[True], owner[1:] != owner[:-1]])]


def _regression(bags: _Bags) -> tuple[np.ndarray, float]:
    """Weights of the scaled features. Alternates between choosing each text's window and fitting on the chosen ones."""
    weights, bias = np.ones(BUCKETS), 0.0
    share = bags.labels.mean()
    balance = np.where(bags.labels > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) / len(bags.labels)
    for _ in range(ROUNDS):
        chosen = bags.best(weights)
        number = np.full(bags.windows, -1)
        number[chosen] = np.arange(len(chosen))
        inside = number[bags.owner] >= 0
        row, feature, value = number[bags.owner[inside]], bags.features[inside], bags.values[inside]
        names, feature = np.unique(feature, return_inverse=True)
        w = weights[names]
        steps_w, steps_b = np.zeros(len(names)), 0.0
        # Plain gradient steps scaled by what they have added up to so far.
        for _ in range(STEPS):
            off = balance * (_logistic(np.bincount(row, value * w[feature], minlength=len(chosen)) + bias) - bags.labels)
            slope = np.bincount(feature, value * off[row], minlength=len(names)) + RIDGE / len(names) * (w - 1)
            steps_w += slope**2
            steps_b += off.sum() ** 2
            w = w - 0.3 * slope / np.sqrt(steps_w + 1e-18)
            bias -= 0.3 * off.sum() / np.sqrt(steps_b + 1e-18)
        weights[names] = w
    return weights, bias


def _calibrated(raw: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve whose middle best parts both classes; a clean text called toxic weighs
    twice as much as a toxic one missed."""
    if not len(raw) or labels.min() == labels.max():
        return 1.0, 0.0
    points = np.unique(raw)
    cuts = np.concatenate([[points[0] - 1], (points[1:] + points[:-1]) / 2, [points[-1] + 1]])
    toxic, clean = np.sort(raw[labels > 0.5]), np.sort(raw[labels < 0.5])
    missed = np.searchsorted(toxic, cuts) / len(toxic)
    wronged = 1 - np.searchsorted(clean, cuts) / len(clean)
    errors = missed + 2 * wronged
    # The middle of the widest run of best cuts leaves most room on both sides.
    good = np.flatnonzero(errors <= errors.min() + 1e-12)
    runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
    edges = [(points[max(r[0] - 1, 0)], points[min(r[-1], len(points) - 1)]) for r in runs]
    low, high = max(edges, key=lambda e: e[1] - e[0])
    middle = (low + high) / 2
    spread = max(float(np.median(toxic) - np.median(clean)), 1e-6)
    slope = 8.0 / spread
    return slope, -slope * middle


def fit(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the texts of ``docs`` that ``labelled`` (the key, ``label`` from 0 to 1) names.

    Several labels of a key are averaged; null keys and labels, and labels without a document, are left
    out; a null text is empty. A key with several texts counts each of them. Log-count ratios use all labelled
    texts but those kept for calibration, the regression at most ``sample`` of each class. Without texts of both
    classes every score is that of the only one, and 0 without labels.
    """
    found = labelled.select(F.col(key).alias("key"), F.col("label").cast("double").alias("label"))
    found = found.where("key is not null and label is not null").groupBy("key").agg(F.avg("label").alias("label"))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Only texts that may have a label are shuffled, always the same way: a small table of labels is no special case.
    rows = common.likely(rows.where("key is not null"), "key", found.select("key")).join(found.hint("merge"), "key")
    rest = F.pmod(F.xxhash64("key", F.lit(31)), F.lit(CALIBRATION)) == 0
    known = common.stored(rows.withColumn("rest", rest), "toxic_labels")
    toxic = F.col("label") >= 0.5
    sides = {(r.toxic, r.rest): r.n for r in known.groupBy(toxic.alias("toxic"), "rest").agg(F.count("*").alias("n")).collect()}
    if len({side for side, _ in sides}) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 1.0, 40.0 if any(side for side, _ in sides) else -40.0)
    # Too few labels to keep some back: the same texts fit and calibrate.
    learned, held = (known.where("not rest"), known.where("rest")) if len(sides) == 4 else (known, known)
    ratios = log_count_ratios(learned)
    chosen = learned.join(F.broadcast(_sampled(learned, sample, 13)), "key").select("key", "label", "text")
    bags = _Bags(_windows_of(chosen, ratios), ratios)
    weights, bias = _regression(bags)
    model = Model(grid(weights * ratios), bias)
    held = held.join(F.broadcast(_sampled(held, CALIBRATION_SAMPLE, 37)), "key")
    raw = score(held, model, key="key", keep=["label"], raw=True).toArrow()
    order = np.lexsort((raw["label"].to_numpy(), raw["score"].to_numpy()))
    labels = (raw["label"].to_numpy() >= 0.5).astype(np.float64)
    model.slope, model.shift = _calibrated(raw["score"].to_numpy()[order], labels[order])
    return model


def score(
    docs: DataFrame,
    model: Model,
    limit: float = LIMIT,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    raw: bool = False,
) -> DataFrame:
    """Key, ``score`` (0 to 1) and ``predicted`` (1 from ``limit`` on) of every row, with the columns ``keep``.

    Texts are read whole. A null text counts as empty and is scored like one; null and repeated keys keep
    their rows, equal texts get equal scores, an empty table gives no rows, other columns are not read
    and may have any name. ``raw``: the sums before the logistic curve.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_text", SLICE_BYTES):
            texts = common.values(batch, "_text")
            found = shared.value.raw(texts) if raw else shared.value.score(texts)
            own = [common.values(batch, f"_{i}") for i in range(1 + len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(found), pa.array((found >= limit).astype(np.int32))],
                names=[*[f"_{i}" for i in range(1 + len(keep))], "score", "predicted"],
            )

    names = [key, *keep]
    kinds = [f"_{i} {docs.schema[name].dataType.simpleString()}" for i, name in enumerate(names)]
    rows = docs.select(*[F.col(name).alias(f"_{i}") for i, name in enumerate(names)], F.col(text).alias("_text"))
    found = rows.mapInArrow(run, ", ".join([*kinds, "score double, predicted int"]))
    return found.select(*[F.col(f"_{i}").alias(name) for i, name in enumerate(names)], "score", "predicted")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels").where(~held_out())
    model = fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return score(docs, model).withColumn("held_out", held_out())


#: A fitted model is not expressible in SQL; tests measure held-out accuracy and compare counts with plain Python.
ORACLE = None
