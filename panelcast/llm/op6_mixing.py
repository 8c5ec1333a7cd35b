"""Mixing sources to target weights by Sainte-Lague apportionment of words.

A source's texts are put in a seeded order, cut into shards of the order, and each shard into
blocks of words. Words are the seats: highest quotients give every source, then every shard of
it, an integer quota. A shard takes all its words so often as they fit in, and of a seeded order
of its blocks the first ones once more; the last of these is cut where the quota ends.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.llm import common

BLOCK_WORDS = 32
#: A shard has about so many words; a source has at most SHARDS of them, larger ones then.
SHARD_WORDS = 1 << 14
SHARDS = 4096
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
SEED = 11
#: Steps through a shard's blocks: primes far above the number of blocks in a shard.
STEPS = (1_000_000_007, 998_244_353)


def apportion(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by the highest quotients ``weight / (seats + 1/2)``, at most ``caps`` each.

    The common divisor is found by bisection, the last seats are dealt one by one, so the work
    does not grow with the number of seats. Ties go to the earlier entry.
    """
    weight, cap = np.asarray(weights, dtype=np.float64), np.asarray(caps, dtype=np.int64)
    seats = int(min(seats, cap[weight > 0].sum()))
    if seats <= 0:
        return [0] * len(weight)

    def dealt(divisor: float) -> np.ndarray:
        return np.minimum(cap, np.floor(np.minimum(weight / divisor + 0.5, 2.0**62))).astype(np.int64)

    low, high = weight[weight > 0].min() / (float(cap.max()) + 2), 4 * weight.sum()
    for _ in range(200):
        middle = (low * high) ** 0.5
        if dealt(middle).sum() > seats:
            low = middle
        else:
            high = middle
    found = np.where(weight > 0, dealt(high), 0)
    heap = [(-weight[i] / (found[i] + 0.5), i) for i in range(len(weight)) if weight[i] > 0 and found[i] < cap[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(found.sum())):
        _, i = heapq.heappop(heap)
        found[i] += 1
        if found[i] < cap[i]:
            heapq.heappush(heap, (-weight[i] / (found[i] + 0.5), i))
    return [int(x) for x in found]


def targets(sizes: list[int], weights: list[float], repeats: int = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above ``repeats`` times its size; the excess is reshared."""
    found, open_sources, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_sources:
        total = sum(weights[i] for i in open_sources)
        over = [i for i in open_sources if left * weights[i] / total > repeats * sizes[i]]
        for i in over or open_sources:
            found[i] = float(repeats * sizes[i]) if over else left * weights[i] / total
        left -= sum(found[i] for i in over)
        open_sources = [i for i in open_sources if i not in over] if over else []
    return found


def mix(
    docs: DataFrame,
    keep: list[str],
    source: str = "source",
    text: str = "text",
    key: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """The columns ``keep``, and what the mix takes, for every row of ``docs``.

    ``size``: words of the text (null: 0). ``source_size`` and ``target``: of the row's source.
    ``taken``: words taken, repeats counted, at most three times the size. ``full``: how often
    the whole text is taken; ``begin``, ``words``, ``extra``, ``turn``: its place in its shard,
    the shard's words, which of them are taken once more (see :func:`chosen`). A source takes its
    target but for rounding to a whole word.

    Sources are ordered by code point, the null source last, and weigh ``weights`` in turn. The
    list of sources is what a mixing recipe spells out, so their totals (one row each) are on
    the driver; documents are not. A shard is one group of a window; a large source has many.
    Rows with equal keys and sizes are interchangeable. A source without words takes none.
    """
    rows = docs.select(
        F.struct(*keep).alias("_kept"),
        F.col(source).alias("_source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(key), F.lit(seed)).alias("_hash"),
        F.col(key).alias("_key"),
    )
    totals = rows.groupBy("_source").agg(F.sum("size").alias("n")).collect()
    totals = sorted(((r._source, r.n) for r in totals), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in totals]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    seats = apportion(goals, [MAX_REPEATS * n for n in sizes], round(sum(goals)))
    recipe = [
        (number, name, n, goal, quota, min(SHARDS, max(1, -(-n // SHARD_WORDS))))
        for number, ((name, n), goal, quota) in enumerate(zip(totals, goals, seats))
    ]
    kind = docs.schema[source].dataType.simpleString()
    columns = f"_number long, _name {kind}, source_size long, target double, _quota long, _shards long"
    recipe = docs.sparkSession.createDataFrame(recipe, columns)

    # The recipe comes from the driver, Spark does not know its size; without the hint documents are shuffled by source.
    placed = rows.join(F.broadcast(recipe), F.col("_source").eqNullSafe(F.col("_name"))).drop("_name")
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64("_hash"), F.col("_shards")))
    # Numbers are never null, so window and join below deal rows by the same columns and documents are shuffled once.
    group = ["_number", "_shard"]

    def share(source_rows: pd.DataFrame) -> pd.DataFrame:
        source_rows = source_rows.sort_values("_shard")
        words = source_rows["words"].to_list()
        caps = [MAX_REPEATS * n for n in words]
        return source_rows.assign(_seats=apportion(words, caps, int(source_rows["_quota"].iloc[0])))

    shards = placed.groupBy(*group, "_quota").agg(F.sum("size").alias("words"))
    shards = shards.groupBy("_number").applyInPandas(share, "_number long, _shard long, _quota long, words long, _seats long")

    along = Window.partitionBy(*group).orderBy("_hash", "_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = placed.withColumn("begin", F.coalesce(F.sum("size").over(along), F.lit(0)))
    begun = begun.join(shards.drop("_quota"), group)
    blocks = F.greatest(F.ceil(F.col("words") / F.lit(block_words)).cast("long"), F.lit(1))
    begun = begun.withColumns(
        {
            "full": F.expr("_seats div greatest(words, 1)"),
            "extra": F.expr("_seats % greatest(words, 1)"),
            "_blocks": blocks,
            "turn": F.pmod(F.xxhash64("_source", "_shard", F.lit(seed)), blocks),
        }
    )
    step = f"if(_blocks % {STEPS[0]} = 0, {STEPS[1]}, {STEPS[0]})"
    begun = begun.withColumn("_last", F.expr(f"pmod((_blocks - 1) * {step} + turn, _blocks)"))
    # As in chosen(): words of block b before the end of the choice, less those before the text.
    at = f"pmod(b * {step} + turn, _blocks)"
    rank = f"{at} * {block_words} - if({at} > _last, _blocks * {block_words} - words, 0)"
    stop = f"least(begin + size, (b + 1) * {block_words}, b * {block_words} + extra - ({rank}))"
    overlap = f"greatest({stop} - greatest(begin, b * {block_words}), 0L)"
    partly = F.expr(
        f"aggregate(sequence(begin div {block_words}, (begin + size - 1) div {block_words}), 0L, (sum, b) -> sum + {overlap})"
    )
    partly = F.when((F.col("size") > 0) & (F.col("extra") > 0), partly).otherwise(F.lit(0))
    taken = (F.col("full") * F.col("size") + partly).cast("long")
    return begun.withColumn("taken", taken).select(
        "_kept.*", "size", "source_size", "target", "taken", "full", "begin", "words", "extra", "turn"
    )


def chosen(begin: int, size: int, words: int, extra: int, turn: int, block_words: int = BLOCK_WORDS) -> np.ndarray:
    """Which words of a text are among the ``extra`` ones that its shard of ``words`` takes once more.

    Blocks are put in a seeded order, the last one of the shard may be short; the first ``extra`` words are taken.
    """
    blocks = max(1, -(-words // block_words))
    step = STEPS[1] if blocks % STEPS[0] == 0 else STEPS[0]
    place = begin + np.arange(size, dtype=np.int64)
    order = (place // block_words * step + turn) % blocks
    last = ((blocks - 1) * step + turn) % blocks
    rank = order * block_words + place % block_words - np.where(order > last, blocks * block_words - words, 0)
    return rank < extra


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", chars: str = "n_chars") -> DataFrame:
    """The mix itself: every text as often as it is taken whole, and its blocks taken once more as a row.

    Returns the columns of ``docs``; ``chars``, where there is such a column, counts the characters of
    a partial text. Its words keep the white space between them; separate runs are joined by a
    line end. Texts without words are in no mix.

    One pass makes both kinds of rows, so a text is shuffled once, to its shard.
    """
    columns = docs.columns
    rows = docs.select(F.struct("*").alias("_row"), key, text, source)
    mixed = mix(rows, ["_row"], source, text, key)
    rest = F.struct(*[F.col(f"_row.`{c}`").alias(c) for c in columns if c != text]).alias("_row")
    partly = F.expr("taken > full * size").alias("partly")
    mixed = mixed.where("taken > 0").select(
        rest, F.col(f"_row.`{text}`").alias("_text"), "full", partly, "size", "begin", "words", "extra", "turn"
    )
    word = re.compile(common.WORD)

    def made(batch: pa.RecordBatch, texts: pa.Array, partial: bool) -> pa.RecordBatch:
        flags = pa.array(np.full(batch.num_rows, partial))
        return pa.RecordBatch.from_arrays([common.values(batch, "_row"), texts, flags], names=["_row", "_text", "_cut"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "_text"):
            full = common.values(batch, "full")
            for times in range(pa.compute.max(full).as_py()):
                whole = batch.filter(pa.compute.greater(full, times))
                yield made(whole, common.values(whole, "_text"), False)
            batch = batch.filter(common.values(batch, "partly"))
            numbers = [common.values(batch, name).to_pylist() for name in ("begin", "size", "words", "extra", "turn")]
            texts = []
            for content, *place in zip(common.values(batch, "_text").to_pylist(), *numbers):
                take = chosen(*place)
                spans = [m.span() for m in word.finditer(content)]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], take.astype(np.int8), [0]])))
                runs = [content[spans[a][0] : spans[b - 1][1]] for a, b in zip(edges[::2], edges[1::2])]
                texts.append("\n".join(runs))
            yield made(batch, pa.array(texts, common.values(batch, "_text").type), True)

    shape = mixed.schema["_row"].dataType.simpleString()
    output = mixed.mapInArrow(cut, f"_row {shape}, _text string, _cut boolean")
    changed = {text: F.col("_text")}
    if chars in columns:
        counted = F.char_length("_text").cast(docs.schema[chars].dataType)
        changed[chars] = F.when(F.col("_cut"), counted).otherwise(F.col(f"_row.`{chars}`"))
    return output.select(*[changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`").alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


#: The seeded choice of blocks is not expressible in SQL; tests recompute targets and totals.
ORACLE = None
