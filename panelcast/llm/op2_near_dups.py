"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

A SuperMinHash signature gives every shingle one random permutation of the components: in
step j a shingle offers the rank j plus a random fraction to the j-th component of its
permutation. A component keeps the least offer. Once every component of a text holds a value
of a step that is over, later steps cannot change it and the text stops early.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm import common, union_find
from panelcast.llm.flat import Flat, draw, mix

#: Values per band, and the probability that a pair just at the limit shares no band.
BAND_ROWS = 6
MISS = 1e-6

_FRACTION = np.uint64(53)
_SECOND = np.uint64(0xA0761D6478BD642F)


def bands_for(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands needed to find pairs of ``percent`` similarity but for a share of ``miss``."""
    hit = (percent / 100) ** rows
    return 1 if hit >= 1 else math.ceil(math.log(miss) / math.log1p(-hit))


def super_minhash(owners: np.ndarray, keys: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Signatures, one row of ``size`` values per text; texts without shingles keep the maximum."""
    best = np.full((texts, size), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = best.reshape(-1)
    rows = owners.astype(np.int64) * size
    drawn: list[np.ndarray] = []  # the partner each earlier step swapped its place with
    for step in range(size):
        if not len(keys):
            break
        fraction = draw(keys, 2 * step) >> np.uint64(64 - 53)
        partner = (np.uint64(step) + draw(keys, 2 * step + 1) % np.uint64(size - step)).astype(np.int16)
        component = partner.copy()
        for earlier in range(step - 1, -1, -1):
            component[drawn[earlier] == component] = earlier
        np.minimum.at(flat, rows + component, (np.uint64(step) << _FRACTION) | fraction)
        drawn.append(partner)
        open_texts = best.max(axis=1) >= (np.uint64(step + 1) << _FRACTION)
        going = open_texts[rows // size]
        if not going.all():
            keys, rows, drawn = keys[going], rows[going], [d[going] for d in drawn]
    return best


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band, different for equal values of different bands."""
    texts, size = signatures.shape
    bands = size // rows
    cut = signatures[:, : bands * rows].reshape(texts, bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (texts, bands)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, k])
    return key


def _sums(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(keys) + 1, dtype=np.uint64)
    np.cumsum(keys, out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int = BAND_ROWS) -> DataFrame:
    """``id``, ``n_shingles``, a 128-bit digest of the set (``d1``, ``d2``) and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            flat = Flat.of(common.values(batch, "text"), lower=True)
            owners, keys = flat.words().shingles(words)
            found = band_keys(super_minhash(owners, keys, flat.rows, bands * rows), rows)
            bounds = np.searchsorted(owners, np.arange(flat.rows + 1))
            offsets = pa.array(np.arange(0, found.size + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    common.values(batch, "id"),
                    pa.array(np.diff(bounds)),
                    pa.array(_sums(keys, bounds)),
                    pa.array(_sums(mix(keys ^ _SECOND), bounds)),
                    pa.ListArray.from_arrays(offsets, pa.array(found.ravel().view(np.int64))),
                ],
                names=["id", "n_shingles", "d1", "d2", "bands"],
            )

    return docs.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose whole shingle sets are similar enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text_b"):
            sides = []
            for name in ("text_a", "text_b"):
                flat = Flat.of(common.values(batch, name), lower=True)
                sides.append(flat.words().shingles(words))
            owners = np.concatenate([side[0] for side in sides])
            keys = np.concatenate([side[1] for side in sides])
            order = np.lexsort((keys, owners))
            owners, keys = owners[order], keys[order]
            shared = (owners[1:] == owners[:-1]) & (keys[1:] == keys[:-1])
            both = np.bincount(owners[1:][shared], minlength=batch.num_rows)
            union = np.bincount(owners, minlength=batch.num_rows) - both
            linked = (100 * both >= percent * union) & (union > 0)
            yield pa.RecordBatch.from_arrays(
                [common.values(batch, "a").filter(pa.array(linked)), common.values(batch, "b").filter(pa.array(linked))],
                names=["a", "b"],
            )

    return pairs.select("a", "b").join(right, "b").join(left, "a").mapInArrow(run, "a long, b long")


def own_shingles(texts: DataFrame, words: int) -> DataFrame:
    """``id`` and ``own``: how many of a text's shingles no other one of ``texts`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            owners, keys = Flat.of(common.values(batch, "text"), lower=True).words().shingles(words)
            yield pa.RecordBatch.from_arrays(
                [common.values(batch, "id").take(pa.array(owners)), pa.array(keys.view(np.int64))], names=["id", "shingle"]
            )

    shingles = texts.mapInArrow(run, "id long, shingle long")
    met = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return met.where("n = 1").groupBy("id").agg(F.count("*").alias("own"))


def differences(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """What a text (``b``) and the leader of its bucket (``a``) do not have in common, one ``shingle`` a row.

    ``linked``: are both similar enough. ``needed``: a text that is not linked to the leader can be
    linked to ``b`` only if it has so many of these shingles among its own differences.

    For a leader L, let x miss M(x) of L's shingles and have E(x) more. Two texts share
    |L| - |M(x)| - |M(y)| + d shingles, d being the number of differences they have in common, and need
    p / (100 + p) of the sum of their sizes. When x is not linked to L, that leaves
    d > (100 |M(y)| + p |E(y)|) / (100 + p).
    """
    kept = ["a", "b", "root", "n_shingles", "shared"]
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text_b"):
            sides = []
            for name in ("text_a", "text_b"):
                flat = Flat.of(common.values(batch, name), lower=True)
                sides.append(flat.words().shingles(words))
            owners = np.concatenate([side[0] for side in sides])
            keys = np.concatenate([side[1] for side in sides])
            extra = np.repeat([False, True], [len(side[0]) for side in sides])
            order = np.lexsort((keys, owners))
            owners, keys, extra = owners[order], keys[order], extra[order]
            same = np.zeros(len(keys) + 1, dtype=bool)
            same[1:-1] = (owners[1:] == owners[:-1]) & (keys[1:] == keys[:-1])
            both = np.bincount(owners[same[1:]], minlength=batch.num_rows)
            alone = ~(same[1:] | same[:-1])
            owners, keys, extra = owners[alone], keys[alone], extra[alone]
            missing = np.bincount(owners[~extra], minlength=batch.num_rows)
            more = np.bincount(owners[extra], minlength=batch.num_rows)
            linked = 100 * both >= percent * (both + missing + more)
            needed = (100 * missing + percent * more) // (100 + percent) + 1
            rows = pa.array(owners)
            yield pa.RecordBatch.from_arrays(
                [
                    *[common.values(batch, name).take(rows) for name in kept],
                    pa.array(linked[owners]),
                    pa.array((missing + more - needed + 1)[owners]),
                    pa.array(keys.view(np.int64)),
                ],
                names=[*kept, "linked", "prefix", "shingle"],
            )

    joined = pairs.join(right, "b").join(left, "a").select(*kept, "text_a", "text_b")
    schema = "a long, b long, root long, n_shingles long, shared long, linked boolean, prefix long, shingle long"
    return joined.mapInArrow(run, schema)


def possible_pairs(found: DataFrame, percent: int) -> DataFrame:
    """Pairs of texts with one leader and different roots that may be linked, by their differences from it.

    One of them is not linked to the leader. It must share one of the other's rarest differences, of
    which so many are looked at that no more are left than ``needed`` less one.
    """
    counts = found.groupBy("a", "shingle").agg(F.count("*").alias("n"))
    along = Window.partitionBy("a", "b").orderBy("n", "shingle")
    rare = found.join(counts, ["a", "shingle"]).withColumn("place", F.row_number().over(along)).where("place <= prefix")
    names = ("b", "root", "n_shingles", "shared")
    one = found.where("not linked").select("a", "shingle", *[F.col(c).alias(f"{c}_1") for c in names])
    two = rare.select("a", "shingle", *[F.col(c).alias(f"{c}_2") for c in names])
    most = "least(shared_1, shared_2)"
    possible = F.expr(f"root_1 != root_2 and 100 * {most} >= {percent} * (n_shingles_1 + n_shingles_2 - {most})")
    pairs = one.join(two, ["a", "shingle"]).where(possible)
    return pairs.select(F.least("b_1", "b_2").alias("a"), F.greatest("b_1", "b_2").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    rows: int = BAND_ROWS,
    miss: float = MISS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Key, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space, and compared by their
    distinct shingles of ``words`` words; shorter texts are one shingle. Two texts are linked
    when their sets' similarity reaches ``percent``. A component's id is its smallest key.

    1. Texts with equal sets are one class, represented by its smallest key.
    2. Representatives that share a band are candidates. In each bucket the text that meets
       most others overall is compared with all of them, which joins a group of copies
       around its source without looking at all pairs.
    3. Pairs of a bucket that are then still in different components are compared as well, but for
       those that cannot be linked: texts with too many shingles of their own, and pairs that
       have too little in common of what sets them apart from their bucket's leader.

    So no link between candidates is lost. A group costs pairs only where its members are not
    linked and yet may be; neither a source with many copies nor far copies are looked at pairwise. Null or empty texts and texts without words link with nothing. Rows with a
    null key are returned with a null component, kept. Rows with one key are one document and
    share their result. Other columns are not read.
    """
    bands = bands_for(percent, rows, miss)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = common.stored(signatures(source, words, bands, rows), "signatures")

    same = ["d1", "d2", "n_shingles"]
    classes = signed.where("n_shingles > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep"))
    classes = common.stored(classes, "classes")
    reps = signed.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    placed = reps.where("n_shingles > 0").select("id", "n_shingles", F.explode("bands").alias("bucket"))
    crowded = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("x"), F.max("id").alias("y"))
    crowded = crowded.where("x != y").select("bucket", "size")
    members = common.stored(placed.join(crowded, "bucket"), "buckets")

    met = members.groupBy("id").agg(F.sum("size").alias("met"))
    ranked = members.join(met, "id")
    leader = F.max(F.struct("met", (-F.col("id")).alias("minus"), "n_shingles")).alias("leader")
    leaders = ranked.groupBy("bucket").agg(leader)
    near = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    stars = members.join(leaders, "bucket").select(
        (-F.col("leader.minus")).alias("a"),
        F.col("id").alias("b"),
        F.col("leader.n_shingles").alias("n_a"),
        F.col("n_shingles").alias("n_b"),
    )
    stars = common.stored(stars.where("a != b").where(near).select("a", "b").distinct(), "pairs")

    ends = members.select("id").distinct()
    texts = common.likely(source, "id", ends).join(ends, "id", "left_semi").dropDuplicates(["id"])
    texts = common.stored(texts, "texts")
    links = common.stored(verified(stars, texts, words, percent), "links")
    roots = union_find.components(links)

    apart = members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select(
        "bucket", "id", "n_shingles", F.coalesce("root", "id").alias("root")
    )
    split = apart.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    apart = common.stored(apart.join(split.select("bucket"), "bucket", "left_semi"), "apart")
    own = own_shingles(texts.join(apart.select("id").distinct(), "id", "left_semi"), words)
    apart = apart.join(own, "id", "left").withColumn("shared", F.col("n_shingles") - F.coalesce("own", F.lit(0)))
    apart = common.stored(apart.where(f"100 * shared >= {percent} * n_shingles").drop("own"), "open")
    held = apart.join(leaders.select("bucket", (-F.col("leader.minus")).alias("a")), "bucket")
    held = held.select("a", F.col("id").alias("b"), "root", "n_shingles", "shared").where("a != b").distinct()
    across = possible_pairs(common.stored(differences(held, texts, words, percent), "differences"), percent)
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = common.stored(across.join(known, ["a", "b"], "left_anti"), "across")
    if not across.isEmpty():
        links = links.unionByName(verified(across, texts, words, percent))
        roots = union_find.components(links)

    answer = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    answer = answer.select(*same, F.coalesce("root", "rep").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = signed.drop("bands").join(answer, same, "left").select("id", "n_shingles", component.alias("component_id"))
    kept = F.col("id").isNull() | (F.col("id") == F.col("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", "component_id", kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=3, percent=85)


#: Sets of whole texts; 64-bit hashes take the place of the shingles themselves. Too slow in
#: SQL for all pairs of a large table, so tests compare with brute force on small ones.
ORACLE = None
