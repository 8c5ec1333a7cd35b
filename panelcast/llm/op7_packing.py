"""Packing documents into windows by non-negative least squares on the length histogram.

A document is cut into full windows and one rest. Combinations of up to three rests that fill
a window exactly are enumerated, their repeat counts solved against the histogram of rests
and rounded down. What is left is packed greedily into exact fillings; rests that no exact
filling can take are poured one after another and cut where a window ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common, tokens
from panelcast.llm.flat import positions

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
WINDOW = 1024
STEPS = 400


@dataclass
class Plan:
    """Places of rests by length and rank among the rests of that length.

    Entry i holds the ranks from ``first[i]`` on of ``lengths[i]`` (sorted by both): the r-th of them goes to
    sequence ``sequence[i] + r`` at ``offset[i]``, or, where ``poured[i]``, to position ``offset[i] + r * length`` of
    the stream of cut rests, whose windows are the sequences from ``pour`` on.
    """

    lengths: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    poured: np.ndarray
    pour: int
    sequences: int


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of two or three of ``lengths`` (0: none), ascending, that add up to ``window``."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    have[0] = True
    small, middle = np.meshgrid(np.concatenate([[0], lengths]), lengths, indexing="ij")
    large = window - small - middle
    fits = (small <= middle) & (middle <= large)
    fits[fits] &= have[large[fits]]
    return np.stack([small[fits], middle[fits], large[fits]], axis=1)


def least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts whose lengths come closest to the histogram (accelerated projected gradient)."""
    size = len(histogram)

    def lengths_of(x: np.ndarray) -> np.ndarray:
        total = np.zeros(size)
        for k in range(3):
            total += np.bincount(combos[:, k], weights=x, minlength=size)
        total[0] = 0
        return total

    def back(y: np.ndarray) -> np.ndarray:
        return y[combos[:, 0]] * (combos[:, 0] > 0) + y[combos[:, 1]] + y[combos[:, 2]]

    goal = histogram.astype(np.float64).copy()
    goal[0] = 0
    vector = np.ones(len(combos))
    for _ in range(20):
        vector = back(lengths_of(vector))
        bound = np.linalg.norm(vector)
        vector /= bound
    x = ahead = np.zeros(len(combos))
    momentum = 1.0
    for _ in range(steps):
        new = np.maximum(0, ahead - back(lengths_of(ahead) - goal) / (1.05 * bound))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, x, momentum = new + (momentum - 1) / faster * (new - x), new, faster
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> Plan:
    """Deal out rests, given how many there are of each length below ``window``.

    The work and the size of the plan depend on the window, not on the number of documents.
    """
    left = histogram.astype(np.int64).copy()
    taken = np.zeros(window, dtype=np.int64)
    entries: list[tuple[int, int, int, int, bool]] = []
    sequences = 0

    def use(parts: list[int], times: int) -> None:
        nonlocal sequences
        offset, same = 0, {}
        for length in parts:
            same.setdefault(length, []).append(offset)
            offset += length
        for length, offsets in same.items():
            for place in offsets:
                entries.append((length, int(taken[length]), sequences, place, False))
                taken[length] += times
                left[length] -= times
        sequences += times

    def most(parts: list[int]) -> int:
        return min(int(left[length]) // parts.count(length) for length in set(parts))

    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window) if len(lengths) else np.zeros((0, 3), dtype=np.int64)
    if len(combos):
        counts = least_squares(combos, left)
        for i in np.argsort(-counts, kind="stable"):
            times = int(counts[i] + 1e-6)
            if times < 1:
                break
            parts = [int(n) for n in combos[i][::-1] if n]
            times = min(times, most(parts))
            if times > 0:
                use(parts, times)
    # Greedy: the longest rest first, then ever the longest that fits, if that fills the window.
    for length in range(window - 1, 0, -1):
        while left[length] > 0:
            parts, gap = [length], window - length
            spare = left.copy()
            spare[length] -= 1
            while gap > 0:
                fitting = np.flatnonzero(spare[1 : min(gap, window - 1) + 1])
                if not len(fitting):
                    break
                best = int(fitting[-1]) + 1
                parts.append(best)
                spare[best] -= 1
                gap -= best
            if gap > 0:
                break
            use(parts, most(parts))
    pour, position = sequences, 0
    for length in range(window - 1, 0, -1):
        if left[length] > 0:
            entries.append((length, int(taken[length]), 0, position, True))
            position += length * int(left[length])
    sequences += -(-position // window)
    entries.sort()
    columns = [np.array(c) for c in zip(*entries)] if entries else [np.zeros(0, dtype=np.int64)] * 4 + [np.zeros(0, dtype=bool)]
    return Plan(*columns, pour, sequences)


def place(plan: Plan, lengths: np.ndarray, ranks: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """For rests: row, start in the rest, length, sequence and offset of each of their pieces."""
    entry = np.searchsorted(plan.lengths * (1 << 44) + plan.first, lengths * (1 << 44) + ranks, side="right") - 1
    rank = ranks - plan.first[entry]
    poured = plan.poured[entry]
    stream = plan.offset[entry] + rank * lengths
    sequence = np.where(poured, plan.pour + stream // window, plan.sequence[entry] + rank)
    offset = np.where(poured, stream % window, plan.offset[entry])
    fits = np.minimum(lengths, window - offset)
    rows = np.arange(len(lengths))
    cut = np.flatnonzero(fits < lengths)
    return (
        np.concatenate([rows, cut]),
        np.concatenate([np.zeros(len(rows), dtype=np.int64), fits[cut]]),
        np.concatenate([fits, (lengths - fits)[cut]]),
        np.concatenate([sequence, sequence[cut] + 1]),
        np.concatenate([offset, np.zeros(len(cut), dtype=np.int64)]),
    )


def pack(
    docs: DataFrame,
    carry: dict[str, Column] | None = None,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of documents and their places: key, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids``.

    A document's ids are those of its text and ``end_id``; a null text counts as empty. Every id lies in
    one piece, sequences have no gaps, and all but at most one are full. ``carry`` replaces ``ids``
    (little-endian 32-bit) by columns computed from it, for results that need no tokens. Rows with
    null or equal keys are documents of their own; extra columns are not read.

    Only the histogram of rests, one number for each length below the window, is on the driver.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    carry = carry or {"ids": F.col("ids")}
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()
    fields = "part int, place long, start long, length long, doc_tokens long, ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, spaces=True).encode
        part, full = TaskContext.get().partitionId(), 0
        rests = np.zeros(window, dtype=np.int64)
        for batch in common.slices(batches, "text", remember=True):
            packed = [p + end for p in encode(common.values(batch, "text"))]
            sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
            pieces = -(-sizes // window)
            owner = np.repeat(np.arange(len(packed)), pieces)
            start = positions(np.zeros(len(packed), dtype=np.int64), pieces) * window
            length = np.minimum(window, sizes[owner] - start)
            whole = length == window
            order = np.zeros(len(owner), dtype=np.int64)
            order[whole] = full + np.arange(whole.sum())
            full += int(whole.sum())
            for i in np.flatnonzero(~whole):
                order[i] = rests[length[i]]
                rests[length[i]] += 1
            content = [packed[o][4 * s : 4 * (s + n)] for o, s, n in zip(owner.tolist(), start.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    common.values(batch, "key").take(pa.array(owner)),
                    pa.array(np.full(len(owner), part, dtype=np.int32)),
                    *[pa.array(v) for v in (order, start, length, sizes[owner])],
                    pa.array(content, pa.binary()),
                ],
                names=["key", "part", "place", "start", "length", "doc_tokens", "ids"],
            )

    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pieces = source.mapInArrow(cut, f"key {kind}, {fields}")
    is_rest = F.col("length") < window
    carried = [F.when(~is_rest, column).alias(f"_{i}") for i, column in enumerate(carry.values())]
    rest_ids = F.when(is_rest, F.col("ids")).alias("ids")
    pieces = pieces.select("key", "part", "place", "start", "length", "doc_tokens", rest_ids, *carried)
    pieces = common.stored(pieces, "pieces")

    rests, fulls = pieces.where(is_rest), pieces.where(~is_rest)
    per_part = rests.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(window, dtype=np.int64)
    for row in rests.groupBy("length").agg(F.count("*").alias("n")).collect():
        histogram[row.length] = row.n
    found = plan(histogram, window)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    ranks = common.prefix_sums(per_part, "part", "n", "before", ["length"]).select("part", "length", "before")
    ranked = rests.join(ranks, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "ids"):
            numbers = {n: common.values(batch, n).to_numpy(zero_copy_only=False) for n in ("length", "rank", "start")}
            row, inner, length, sequence, offset = place(shared.value, numbers["length"], numbers["rank"], window)
            content = common.values(batch, "ids").to_pylist()
            ids = [content[r][4 * i : 4 * (i + n)] for r, i, n in zip(row.tolist(), inner.tolist(), length.tolist())]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    common.values(batch, "key").take(rows),
                    pa.array(numbers["start"][row] + inner),
                    pa.array(length),
                    common.values(batch, "doc_tokens").take(rows),
                    pa.array(sequence),
                    pa.array(offset),
                    pa.array(ids, pa.binary()),
                ],
                names=["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    columns = f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    placed = ranked.select("key", "start", "length", "rank", "doc_tokens", "ids").mapInArrow(put, columns)
    names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset"]
    placed = placed.select(*names, *[column.alias(name) for name, column in carry.items()])

    per_full = fulls.groupBy("part").agg(F.count("*").alias("n"))
    numbers = common.prefix_sums(per_full, "part", "n", "before").select("part", "before")
    own = (F.lit(found.sequences) + F.col("before") + F.col("place")).alias("sequence_id")
    alone = fulls.join(numbers, "part").select(
        *names[:4], own, F.lit(0).cast("long").alias("offset"), *[F.col(f"_{i}").alias(n) for i, n in enumerate(carry)]
    )
    return alone.unionByName(placed).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), {"ids_crc32": F.crc32("ids")})


#: Tokenizers are not expressible in SQL; tests compare with direct encoding and check every sequence.
ORACLE = None
