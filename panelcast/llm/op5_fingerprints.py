"""Document fingerprints by one-permutation MinHash.

Every shingle is hashed once; the high bits choose a bin and a bin keeps its least hash.
Empty bins copy a filled one, found by trying a fixed pseudo-random sequence of bins (optimal
densification). Of each bin the low ``bits`` bits are stored; chance agreement of so few bits
is taken out again when two fingerprints are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.flat import Flat, draw

WORDS = 5
BINS = 256  # a power of two
BITS = 4


def bins_of(owners: np.ndarray, keys: np.ndarray, texts: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash per text and bin, and which bins are filled. Shingles come sorted by text and hash."""
    place = owners * bins + (keys >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    least, filled = np.zeros(texts * bins, dtype=np.uint64), np.zeros(texts * bins, dtype=bool)
    least[place[new]] = keys[new]
    filled[place[new]] = True
    return least.reshape(texts, bins), filled.reshape(texts, bins)


def densify(least: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill empty bins from filled ones; a text without any filled bin stays as it is."""
    least = least.copy()
    rows, empty = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        other = (draw(empty.astype(np.uint64), attempt) % np.uint64(filled.shape[1])).astype(np.int64)
        found = filled[rows, other]
        least[rows[found], empty[found]] = least[rows[found], other[found]]
        rows, empty, attempt = rows[~found], empty[~found], attempt + 1
    return least


def fingerprint(texts: pa.Array, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Packed fingerprints; a text without words has the empty one."""
    flat = Flat.of(texts, lower=True)
    owners, keys = flat.words().shingles(words)
    least, filled = bins_of(owners, keys, flat.rows, bins)
    low = (densify(least, filled) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    spread = (low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    packed = np.packbits(spread.reshape(flat.rows, bins * bits), axis=1)
    some = filled.any(axis=1)
    return [packed[i].tobytes() if some[i] else b"" for i in range(flat.rows)]


def likeness(one: list[bytes], two: list[bytes], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Estimated similarity of the shingle sets, from 0 to 1; two empty sets are alike."""
    size = bins * bits // 8
    blank = bytes(size)
    sides = [np.frombuffer(b"".join(x or blank for x in side), dtype=np.uint8).reshape(-1, size) for side in (one, two)]
    differs = np.unpackbits(sides[0] ^ sides[1], axis=1).reshape(-1, bins, bits).any(axis=2)
    chance = 0.5**bits
    estimate = np.clip((1 - differs.mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    empty = np.array([[not x for x in side] for side in (one, two)]).reshape(2, -1)
    return np.where(empty.all(axis=0), 1.0, np.where(empty.any(axis=0), 0.0, estimate))


def fingerprints(
    docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Key and ``fingerprint`` (binary) of every row; a null text counts as empty.

    Shingles have ``words`` words, lower-cased (A-Z); a shorter text is one shingle. Compare
    fingerprints with :func:`likeness`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            found = fingerprint(common.values(batch, "text"), words, bins, bits)
            yield pa.RecordBatch.from_arrays(
                [common.values(batch, "key"), pa.array(found, pa.binary())], names=[key, "fingerprint"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, fingerprint binary"
    )


_FIELDS = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _with_next(keys: list, texts: list[str], key: str, settings: tuple[int, int, int]) -> dict[str, list]:
    """Results of all texts but the last, each with its follower."""
    words, bins, bits = settings
    edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:])]
    plain = fingerprint(pa.array(texts, pa.large_string()), words, bins, bits)
    other = fingerprint(pa.array(edited, pa.large_string()), words, bins, bits)
    return {
        key: keys[:-1],
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": plain[:-1],
        "edited_fingerprint": other,
        "near_edited": likeness(plain[:-1], other, bins, bits),
        "near_next": likeness(plain[:-1], plain[1:], bins, bits),
    }


def edited_fingerprints(
    docs: DataFrame, words: int = WORDS, bins: int = BINS, bits: int = BITS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last ``floor(n_chars / 2)`` characters replaced by the first ones of
    the next row in ascending order of the key (ties by text, nulls first; the last row is
    followed by the first). Texts are dealt out once, by ranges of the key; the rows on
    both sides of a range's border meet in a table with one row per range. A null text counts
    as empty; extra columns are not read.
    """
    settings = (words, bins, bits)
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"range int, side int, text string, key {kind}, {_FIELDS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        keys: list = []
        texts: list[str] = []
        kinds = None

        def rows(side: int, own_text: list, found: dict[str, list]) -> pa.RecordBatch:
            n = len(found["key"])
            done = {"range": pa.array([number] * n, pa.int32()), "side": pa.array([side] * n, pa.int32())}
            done["text"] = pa.array(own_text, pa.string())
            done["key"] = pa.array(found["key"], kinds)
            for name, kind in zip(("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"), (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())):
                done[name] = pa.array(found.get(name, [None] * n), kind)
            return pa.RecordBatch.from_pydict(done)

        for batch in common.slices(batches, "text"):
            kinds = common.values(batch, "key").type
            fresh = not texts
            keys += common.values(batch, "key").to_pylist()
            texts += common.values(batch, "text").to_pylist()
            if fresh:
                yield rows(1, texts[:1], {"key": keys[:1]})
            if len(texts) > 1:
                found = _with_next(keys, texts, "key", settings)
                yield rows(0, [None] * (len(texts) - 1), found)
                keys, texts = keys[-1:], texts[-1:]
        if texts:
            yield rows(2, texts, {"key": keys})

    ranged = source.repartitionByRange("key").sortWithinPartitions("key", "text")
    placed = common.stored(ranged.mapInArrow(run, schema), "fingerprints")

    ends = placed.where("side = 1").select("range")
    along = Window.partitionBy(F.lit(0)).orderBy("range")
    order = ends.select("range", F.lead("range").over(along).alias("after"), F.min("range").over(along).alias("first"))
    order = order.select("range", F.coalesce("after", "first").alias("after"))
    heads = placed.where("side = 1").select(F.col("range").alias("after"), F.col("text").alias("next_text"))
    seams = placed.where("side = 2").select("range", "key", "text").join(order, "range").join(heads, "after")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (common.values(batch, name).to_pylist() for name in ("key", "text", "next_text"))
            for own, one, two in zip(*columns):
                found = _with_next([own, own], [one, two], "key", settings)
                kinds = common.values(batch, "key").type
                types = (kinds, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, v), t in zip(found.items(), types)})

    closed = seams.select("key", "text", "next_text").mapInArrow(close, f"key {kind}, {_FIELDS}")
    whole = placed.where("side = 0").drop("range", "side", "text").unionByName(closed)
    return whole.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(common.table(spark, sf_dir, "documents"))
    texts = {name: F.lower(F.hex(name)) for name in ("fingerprint", "edited_fingerprint")}
    return found.withColumns(texts)


#: The fingerprints are not expressible in SQL; tests hold them against true similarities.
ORACLE = None
