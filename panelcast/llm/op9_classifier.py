"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Texts are counted in a fixed number of features (bytes, hashed byte trigrams, words that repeat
what stands shortly before them), weighted by inverse document frequencies over all texts, and projected to the leading right singular
vectors of a bounded sample of labelled texts. The sample's vectors are broadcast; every text is
compared with all of them in blocked matrix products and takes the vote of the nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.flat import Flat, draw

TRIGRAM_FEATURES = 1792
#: A word counts as a repetition when it equals the word so many places before it.
ECHOES = (1, 2, 3, 4)
ECHO_WEIGHT = 3.0
FEATURES = 256 + TRIGRAM_FEATURES + len(ECHOES) + 1
#: Labelled rows at most that the classifier keeps, and the shape of its space and vote.
SAMPLE = 4096
DIMENSIONS = 64
NEIGHBOURS = 24
SHARPNESS = 8
LIMIT = 0.7


def counts(texts: pa.Array) -> np.ndarray:
    """How often each feature occurs in each text; the last one is the number of words."""
    flat = Flat.of(texts)
    words = flat.words()
    echoes = []
    for back in ECHOES:
        same = (words.hashes[back:] == words.hashes[:-back]) & (words.texts[back:] == words.texts[:-back])
        echoes.append(np.bincount(words.texts[back:][same], minlength=flat.rows))
    echoes = np.stack([*echoes, words.counts], axis=1)
    owners = np.repeat(np.arange(flat.rows), np.diff(flat.bounds))
    single = np.bincount(owners * 256 + flat.data, minlength=flat.rows * 256).reshape(flat.rows, 256)
    codes = flat.data.astype(np.uint64)
    if len(codes) < 3:
        return np.hstack([single, np.zeros((flat.rows, TRIGRAM_FEATURES), dtype=single.dtype), echoes])
    joined = (codes[:-2] << np.uint64(16)) | (codes[1:-1] << np.uint64(8)) | codes[2:]
    inside = owners[:-2] == owners[2:]
    feature = (draw(joined[inside], 0) % np.uint64(TRIGRAM_FEATURES)).astype(np.int64)
    place = owners[:-2][inside] * TRIGRAM_FEATURES + feature
    triple = np.bincount(place, minlength=flat.rows * TRIGRAM_FEATURES).reshape(flat.rows, TRIGRAM_FEATURES)
    return np.hstack([single, triple, echoes])


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of damped relative frequencies times ``idf``; a text without features stays zero."""
    sizes = np.maximum(found[:, :256].sum(axis=1, keepdims=True), 1)
    echo = slice(FEATURES - 1 - len(ECHOES), FEATURES - 1)
    shares = np.empty(found.shape, dtype=np.float32)
    shares[:, : echo.start] = found[:, : echo.start] / sizes
    shares[:, echo] = ECHO_WEIGHT * found[:, echo] / np.maximum(found[:, -1:], 1)
    shares[:, -1] = 0
    rows = np.sqrt(shares) * idf.astype(np.float32)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


@dataclass
class Model:
    """``projection``: features to dimensions; ``vectors``: unit rows of the sample."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, found: np.ndarray) -> np.ndarray:
        rows = weighted(found, self.idf) @ self.projection
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        return rows / np.where(norms > 0, norms, 1)

    def vote(self, found: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Mean label of the nearest sample rows, weighted by a power of the cosine.

        All rows as near as the last neighbour take part, so ties do not depend on order. A
        text without features is as near to all: it gets the mean label.
        """
        prior = float(self.labels.mean()) if len(self.labels) else 0.0
        if not len(self.labels) or not len(found):
            return np.full(len(found), prior)
        near = np.round(self.latent(found) @ self.vectors.T, 5)
        k = min(neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        weights = np.where(near >= last[:, None], np.maximum(near, 0), 0).astype(np.float64) ** SHARPNESS
        total = weights.sum(axis=1)
        return np.where(total > 0, weights @ self.labels / np.where(total > 0, total, 1), prior)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of rows and, per feature, of rows that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, dtype=np.int64), 0
        for batch in common.slices(batches, "text"):
            total += (counts(common.values(batch, "text")) > 0).sum(axis=0)
            rows += batch.num_rows
        feature = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"feature": np.concatenate([[-1], feature]), "n": np.concatenate([[rows], total[feature]])}
        )

    per_task = docs.select(F.col(text).alias("text")).mapInArrow(run, "feature long, n long")
    found = {r.feature: r.n for r in per_task.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(FEATURES)], dtype=np.int64)


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """Fit on at most ``sample`` rows of ``labelled`` (``doc_id``, ``label`` from 0 to 1).

    The rows with the smallest hashes are taken, so a rerun takes the same. Document
    frequencies come from all ``docs``. Several labels of one document are averaged; null
    labels and labels without a document are left out. Without labels every score is 0.
    """
    labels = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    ids = docs.select("doc_id").distinct().join(labels, "doc_id")
    chosen = ids.orderBy(F.xxhash64(F.col("doc_id"), F.lit(9)), "doc_id").limit(sample)
    rows, frequencies = document_frequencies(docs)
    idf = np.log((1 + rows) / (1 + frequencies)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = counts(common.values(batch, "text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [
                    common.values(batch, "doc_id"),
                    common.values(batch, "label"),
                    pa.array([row.tobytes() for row in found], pa.binary()),
                ],
                names=["doc_id", "label", "counts"],
            )

    texts = docs.select("doc_id", "text").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    table = texts.mapInArrow(run, "doc_id long, label double, counts binary").toArrow().sort_by("doc_id")
    found = np.frombuffer(b"".join(table["counts"].to_pylist()), dtype=np.float32).reshape(-1, FEATURES)
    rows_in = weighted(found, idf)
    _, vectors = np.linalg.eigh((rows_in.T @ rows_in).astype(np.float64))
    projection = np.ascontiguousarray(vectors[:, ::-1][:, :dimensions], dtype=np.float32)
    model = Model(idf, projection, np.zeros((0, dimensions), dtype=np.float32), table["label"].to_numpy())
    model.vectors = model.latent(found)
    return model


def score(docs: DataFrame, model: Model, limit: float = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``score`` (0 to 1) and ``predicted`` (1 from ``limit`` on) of every row.

    Null texts count as empty and get the mean label. Null and repeated keys are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = np.clip(shared.value.vote(counts(common.values(part, "text"))), 0.0, 1.0)
                predicted = (found >= limit).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [common.values(part, "key"), pa.array(found), pa.array(predicted)], names=[key, "score", "predicted"]
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    place = F.crc32(F.col("doc_id").cast("string")) % 4
    labels = common.table(spark, sf_dir, "labels").where(place != 2)
    model = fit(docs, labels.select("doc_id", F.col("quality").cast("double").alias("label")))
    return score(docs, model).withColumn("held_out", F.coalesce(place == 2, F.lit(False)))


#: A fitted model is not expressible in SQL; tests measure held-out accuracy.
ORACLE = None
