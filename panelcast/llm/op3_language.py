"""Language identification by character language models.

One interpolated Kneser-Ney model per language; a text gets the language with the lowest
cross-entropy per character. Score and rejection are calibrated on labelled texts that the
models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common, kneser_ney

#: Expected number of labelled texts per language that a model is fitted on; hashes of the
#: keys choose them. Texts are used whole.
SAMPLE = 600
#: One in so many of them is kept for calibration.
CALIBRATION = 5
UNDETERMINED = "und"
#: A text is rejected when its cross-entropy is so many times what nearly all calibration texts stay below.
SLACK = 1.25
SHARE = 0.999
SLICE_BYTES = 1 << 20


@dataclass
class Identifier:
    """``sharpness``: how fast the score rises with the lead; ``limit``: highest accepted cross-entropy."""

    model: kneser_ney.Model
    sharpness: float
    limit: float

    def shares(self, entropies: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        logits = -self.sharpness * np.sqrt(lengths)[:, None] * (entropies - entropies.min(axis=1, keepdims=True))
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of prepared texts; the empty ones are undetermined."""
        languages = np.array(self.model.languages, dtype=object)
        named = np.full(len(texts), UNDETERMINED, dtype=object)
        score, rejected = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        some = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
        if len(some) and len(languages):
            entropies = self.model.cross_entropies([texts[i] for i in some])
            lengths = np.array([len(texts[i]) + 1 for i in some], dtype=np.float64)
            best = entropies.argmin(axis=1)
            named[some] = languages[best]
            score[some] = self.shares(entropies, lengths)[np.arange(len(some)), best]
            rejected[some] = entropies[np.arange(len(some)), best] > self.limit
        return list(named), score, rejected


def prepared(text: Column) -> Column:
    """Lower-cased letters and marks, everything between them as one blank; null becomes empty."""
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")
    bare = F.trim(letters)
    return F.when(bare.rlike(r"\p{L}"), bare).otherwise(F.lit(""))


def _counts(rows: DataFrame) -> DataFrame:
    """Highest-order n-grams and how often they occur, by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text", SLICE_BYTES):
            names = common.values(batch, "lang").to_pylist()
            texts = common.values(batch, "text").to_pylist()
            for name in sorted(set(names)):
                keys, _ = kneser_ney.grams([t for t, n in zip(texts, names) if n == name])
                gram, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": [name] * len(gram), "gram": gram.view(np.int64), "n": n.astype(np.int64)},
                    schema=pa.schema({"lang": pa.string(), "gram": pa.int64(), "n": pa.int64()}),
                )

    found = rows.mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Identifier:
    """Fit on ``labelled``; rows without key, text, letters or language are left out.

    A language's rows enter with the probability that makes ``sample`` of them expected, by
    the hash of their key: the classifier's size does not grow with the table.
    """
    rows = labelled.select(F.col(key).alias("key"), prepared(F.col(text)).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("key is not null and lang is not null and text != ''")
    totals = labelled.where(F.col(key).isNotNull() & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang"))
    totals = {r.lang: r.n for r in totals.agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Identifier(kneser_ney.Model([], np.zeros(0)), 1.0, 0.0)
    place = F.pmod(F.xxhash64(F.col("key"), F.lit(3)), F.lit(1_000_000))
    share = F.create_map(*[x for name, n in totals.items() for x in (F.lit(name), F.lit(sample / n * 1_000_000))])
    # The key decides before a text is prepared: the optimizer moves this filter into the scan's.
    chosen = rows.where(place < share[F.col("lang")])
    chosen = common.stored(chosen.withColumn("fold", F.pmod(F.xxhash64(F.col("key"), F.lit(5)), F.lit(CALIBRATION))), "labelled")

    table = _counts(chosen.where("fold != 0")).toArrow()
    held = chosen.where("fold = 0").select("lang", "text").toArrow()
    names = np.array(table["lang"].to_pylist(), dtype=object)
    grams, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    if not len(grams):
        return Identifier(kneser_ney.Model([], np.zeros(0)), 1.0, 0.0)
    alphabet = len(np.unique(grams & np.uint64(0xFFFF))) + 1
    models = [kneser_ney.one_language(name, grams[names == name], n[names == name], alphabet) for name in sorted(set(names))]
    found = Identifier(kneser_ney.joined(models), 1.0, float("inf"))
    return _calibrated(found, held["lang"].to_pylist(), held["text"].to_pylist())


def _calibrated(found: Identifier, names: list[str], texts: list[str]) -> Identifier:
    place = {name: i for i, name in enumerate(found.model.languages)}
    known = [i for i, name in enumerate(names) if name in place]
    if not known:
        return found
    texts = [texts[i] for i in known]
    truth = np.array([place[names[i]] for i in known])
    parts = [found.model.cross_entropies(texts[i : i + 200]) for i in range(0, len(texts), 200)]
    entropies, lengths = np.concatenate(parts), np.array([len(t) + 1.0 for t in texts])

    def loss(sharpness: float) -> float:
        shares = Identifier(found.model, sharpness, 0.0).shares(entropies, lengths)
        # Half a case of doubt keeps the score below certainty when all calibration texts are right.
        right = shares[np.arange(len(truth)), truth] * (1 - 0.5 / len(truth)) + 0.5 / len(truth) / shares.shape[1]
        return -float(np.log(right).sum())

    sharpness = min((0.25 * 2**k for k in range(10)), key=loss)
    limit = SLACK * float(np.quantile(entropies.min(axis=1), SHARE))
    return Identifier(found.model, sharpness, limit)


def identify(docs: DataFrame, identifier: Identifier, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Key, ``lang_pred``, ``score`` (0 to 1) and ``rejected``, with the columns ``keep``, of every row.

    A null text, or one without a letter, is ``und`` with score 0 and rejected. Others are
    rejected when even their best language explains them much worse than it explains its own
    texts. Languages that are equally good rank by name. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    keep = [key] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_prepared", SLICE_BYTES):
            named, score, rejected = shared.value.predict(common.values(batch, "_prepared").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[common.values(batch, f"_{i}") for i in range(len(keep))], pa.array(named, pa.string()), pa.array(score), pa.array(rejected)],
                names=[*[f"_{i}" for i in range(len(keep))], "lang_pred", "score", "rejected"],
            )

    kept = [F.col(name).alias(f"_{i}") for i, name in enumerate(keep)]
    kinds = [f"_{i} {docs.schema[name].dataType.simpleString()}" for i, name in enumerate(keep)]
    rows = docs.select(*kept, prepared(F.col(text)).alias("_prepared"))
    found = rows.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double, rejected boolean"]))
    return found.select(*[F.col(f"_{i}").alias(name) for i, name in enumerate(keep)], "lang_pred", "score", "rejected")


def fold(key: str = "doc_id") -> Column:
    """Is the row held out of learning: the remainder of its key's checksum by 5 is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    identifier = fit(docs.where(~fold()))
    return identify(docs, identifier).withColumn("held_out", fold())


#: A fitted model is not expressible in SQL; tests measure held-out accuracy.
ORACLE = None
