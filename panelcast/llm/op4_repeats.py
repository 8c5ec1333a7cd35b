"""Repeated substrings by bucket-pointer refinement of suffixes.

A suffix's bucket is named by the content of its first bytes. Names of longer prefixes come from
names at later offsets: the bucket for 2n bytes is the pair of the buckets for n bytes at a
position and n bytes after it, and each refinement feeds the next (8, 16, 32, 64, 100 bytes).
Names depend on content only, so suffixes of different tasks can be sorted together.

Sorting every suffix of a corpus would move many times its size, so only suffixes that can be
repeated are: a window of 100 bytes falls to the 40-byte bucket with the least name among those inside it,
and equal windows fall to the same one. Neighbouring windows that fall to one bucket are a run.
Runs of a bucket are refined by their first and last window: runs with equal contents are repeats
but for the earliest; where contents differ, near the ends of a repeat, the windows themselves are
refined and sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common
from panelcast.llm.flat import Flat, mix, positions

#: Bytes of a repeat, and of the buckets that windows fall to.
LENGTH = 100
GRAM = 40
SLICE_BYTES = 1 << 19
#: Entries that a task gathers before it deals them out, and packs per shuffle partition.
GATHER = 1 << 19
PACKS = 2

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(1 << 63)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _ODD + right)


def refine(names: np.ndarray, length: int, target: int) -> np.ndarray:
    """Names of ``target`` bytes from names of ``length`` bytes at all positions where they fit."""
    while length < target:
        step = min(length, target - length)
        names = _pair(names[:-step], names[step:]) if len(names) > step else names[:0]
        length += step
    return names


def eight(data: np.ndarray) -> np.ndarray:
    """The bucket names of eight bytes: the bytes themselves."""
    names = data.astype(np.uint64)
    for step in (1, 2, 4):
        names = names[:-step] | (names[step:] << np.uint64(8 * step)) if len(names) > step else names[:0]
    return names


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over all windows of ``width`` values."""
    done = 1
    while done < width and len(values):
        step = min(done, width - done)
        values = pick(values[:-step], values[step:]) if len(values) > step else values[:0]
        done += step
    return values


class Suffixes:
    """Bucket names of all suffixes of a slice; ``first[i]`` windows start where a text has ``LENGTH`` bytes left."""

    def __init__(self, flat: Flat):
        self.flat = flat
        base = refine(eight(flat.data), 8, 32)
        # Never zero: that stands for places without a window.
        self.grams = refine(base, 32, GRAM) | np.uint64(1)
        self.windows = refine(base, 32, LENGTH)
        sizes = np.diff(flat.bounds)
        self.counts = np.maximum(0, sizes - LENGTH + 1)
        self.valid = np.zeros(len(self.windows), dtype=bool)
        self.valid[positions(flat.bounds[:-1], self.counts)] = True

    def runs(self) -> dict[str, np.ndarray]:
        """Runs of windows that fall to one bucket: its name, first and last window, name of the content.

        A run has at most as many windows as share a byte with its first. Where a bucket occurs twice in
        a run, windows of the run may equal each other: such runs are given twice, under two contents.
        """
        width = LENGTH - GRAM + 1
        least = _sliding(self.grams, width, np.minimum)
        at = np.flatnonzero(self.valid)
        if not len(at):
            empty = np.zeros(0, dtype=np.int64)
            return {"name": empty.astype(np.uint64), "around": empty.astype(np.uint64), "first": empty, "last": empty}
        names = least[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (names[1:] != names[:-1]) | (at[1:] != at[:-1] + 1)
        start = np.flatnonzero(new)
        long = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        start = np.flatnonzero(long % width == 0)
        first, last = at[start], at[np.append(start[1:], len(at)) - 1]
        name = names[start]
        content = _pair(_pair(self.windows[first], self.windows[last]), (last - first).astype(np.uint64))
        twice = np.flatnonzero(self._again(name, first, last + width - 1))
        return {
            "name": np.concatenate([name, name[twice]]),
            "around": np.concatenate([content, ~content[twice]]),
            "first": np.concatenate([first, first[twice]]),
            "last": np.concatenate([last, last[twice]]),
        }

    def _again(self, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Does a bucket name occur more than once among the positions from ``low`` to ``high``."""
        size = len(self.grams)
        offsets = np.arange(int((high - low).max()) + 1)
        found = np.zeros(len(name), dtype=np.int64)
        for offset in offsets:
            at = low + offset
            found += (at <= high) & (self.grams[np.minimum(at, size - 1)] == name)
        return found > 1


#: What is known of a run: see :meth:`Suffixes.runs`. ``text`` tells texts of one key apart. On
#: the way, 48 bits of ``around`` are kept, and ``last`` is counted from ``first``.
_ENTRY = [("name", "<u8"), ("around", "<u8"), ("id", "<i8"), ("text", "<u8"), ("first", "<u4"), ("last", "<u4")]
_AROUND_BYTES = 6
_COLUMNS = [name for name, _ in _ENTRY]


def _earliest(entries: dict[str, np.ndarray], keys: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Entries ordered by ``keys`` and place, and which of them are the first of their key.

    Entries of one place come from rows that share key and text; one of them is left.
    """
    place = ("id", "text", "first", "last")
    order = np.lexsort([entries[c] for c in (*reversed(place), *reversed(keys))])
    entries = {c: v[order] for c, v in entries.items()}
    new, other = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
    new[1:] = np.any([entries[k][1:] != entries[k][:-1] for k in keys], axis=0)
    other[1:] = new[1:] | np.any([entries[c][1:] != entries[c][:-1] for c in place], axis=0)
    return {c: v[other] for c, v in entries.items()}, new[other]


def _packed(entries: dict[str, np.ndarray], packs: int) -> pa.RecordBatch | None:
    """One row for each pack that the entries' names fall into."""
    pack = (entries["name"] % np.uint64(packs)).astype(np.int64)
    order = np.argsort(pack, kind="stable")
    pack = pack[order]
    starts = np.flatnonzero(np.concatenate([[True], pack[1:] != pack[:-1]])) if len(pack) else np.zeros(0, dtype=np.int64)
    if not len(starts):
        return None
    ends = np.append(starts[1:], len(pack)).tolist()
    columns = {"pack": pa.array(pack[starts].astype(np.int32)), "kind": pa.array(np.zeros(len(starts), dtype=np.int32))}
    entries = {c: v[order] for c, v in entries.items()}
    for name, _ in _ENTRY:
        columns[name] = pa.array([_bytes(entries, name, slice(a, b)) for a, b in zip(starts.tolist(), ends)], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


def _bytes(entries: dict[str, np.ndarray], name: str, part: slice) -> bytes:
    values = entries[name][part]
    if name == "around":
        return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_AROUND_BYTES].tobytes()
    if name == "last":
        return (values - entries["first"][part]).astype(np.uint8).tobytes()
    return values.astype(dict(_ENTRY)[name]).tobytes()


def _unpacked(rows: list[dict]) -> dict[str, np.ndarray]:
    data = {n: b"".join(r[n] for r in rows) for n in _COLUMNS}
    found = {n: np.frombuffer(data[n], dtype=k) for n, k in _ENTRY if n not in ("around", "last")}
    around = np.zeros((len(found["name"]), 8), dtype=np.uint8)
    around[:, :_AROUND_BYTES] = np.frombuffer(data["around"], dtype=np.uint8).reshape(-1, _AROUND_BYTES)
    found["around"] = around.view("<u8").ravel()
    found["last"] = found["first"] + np.frombuffer(data["last"], dtype=np.uint8)
    return found


def _packed_spans(entries: dict[str, np.ndarray], pack: int) -> pa.RecordBatch:
    """Repeats that are already known travel along in a pack of their own."""
    columns = {"pack": pa.array([pack], pa.int32()), "kind": pa.array([1], pa.int32())}
    for name in _COLUMNS:
        columns[name] = pa.array([_bytes(entries, name, slice(None))], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


_PACK_SCHEMA = "pack int, kind int, " + ", ".join(f"{c} binary" for c in _COLUMNS)
_FOUND_SCHEMA = "id long, text long, first long, last long, open boolean"


class _Gatherer:
    """Gathers entries of a task, keeps the earliest of equal ones, and deals them out in packs."""

    def __init__(self, packs: int, keys: list[str]):
        self.packs, self.keys, self.held, self.size = packs, keys, [], 0

    def add(self, entries: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.held.append(entries)
        self.size += len(entries["name"])
        if self.size >= GATHER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            entries = {c: np.concatenate([e[c] for e in self.held]) for c in _COLUMNS}
            entries, first = _earliest(entries, self.keys)
            if not first.all():
                spans = {c: v[~first] for c, v in entries.items()}
                yield _packed_spans(spans, int((mix(spans["name"][:1]) % np.uint64(self.packs))[0]))
            batch = _packed({c: v[first] for c, v in entries.items()}, self.packs)
            if batch is not None:
                yield batch
        self.held, self.size = [], 0


def _by_pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]:
    """Entries and known repeats of each pack; packs arrive one after another."""

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["pack"] != row["pack"]:
                yield _unpacked([r for r in held if r["kind"] == 0]), _unpacked([r for r in held if r["kind"] == 1])
                held = []
            held.append(row)
    if held:
        yield _unpacked([r for r in held if r["kind"] == 0]), _unpacked([r for r in held if r["kind"] == 1])


def _rows(entries: dict[str, np.ndarray], open_: np.ndarray) -> pa.RecordBatch:
    values = [pa.array(entries[c].astype(np.int64)) for c in ("id", "text", "first", "last")]
    return pa.RecordBatch.from_arrays([*values, pa.array(open_)], names=["id", "text", "first", "last", "open"])


def _resolve_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs with equal contents: all but the earliest are repeats. Buckets with different ones stay open."""
    for entries, spans in _by_pack(batches):
        if len(spans["name"]):
            yield _rows(spans, np.zeros(len(spans["name"]), dtype=bool))
        if not len(entries["name"]):
            continue
        entries, first = _earliest(entries, ["name", "around"])
        again = ~first
        kinds = first.astype(np.int64)
        bucket = np.concatenate([[0], np.cumsum(entries["name"][1:] != entries["name"][:-1])])
        several = np.bincount(bucket, weights=kinds)[bucket] > 1
        pick = again | (first & several)
        if pick.any():
            yield _rows({c: v[pick] for c, v in entries.items()}, first[pick])


def _resolve_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal windows: all but the earliest are repeats."""
    for entries, spans in _by_pack(batches):
        for part in (spans, None):
            if part is None:
                ordered, first = _earliest(entries, ["name"])
                part = {c: v[~first] for c, v in ordered.items()}
            if len(part["name"]):
                yield _windows_as_rows(part)


def _windows_as_rows(part: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Neighbouring windows of a text become one row."""
    order = np.lexsort([part[c] for c in ("first", "text", "id")])
    part = {c: v[order] for c, v in part.items()}
    new = np.ones(len(order), dtype=bool)
    new[1:] = (part["id"][1:] != part["id"][:-1]) | (part["text"][1:] != part["text"][:-1])
    new[1:] |= part["first"][1:].astype(np.int64) > part["last"][:-1].astype(np.int64) + 1
    start = np.flatnonzero(new)
    last = part["last"][np.append(start[1:], len(order)) - 1]
    merged = {"id": part["id"][start], "text": part["text"][start], "first": part["first"][start], "last": last}
    return _rows(merged, np.zeros(len(start), dtype=bool))


def _text_names(batch: pa.RecordBatch) -> np.ndarray:
    """64-bit names that tell texts of one key apart."""
    return common.values(batch, "mark").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def repeats(docs: DataFrame, packs: int | None = None) -> DataFrame:
    """``id``, ``text`` (a name of the text) and the ``first`` and ``last`` start of runs of repeated windows.

    ``docs`` has ``id``, ``text`` and ``mark``, a hash of the text (no nulls).
    """
    spark = docs.sparkSession
    packs = packs or PACKS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gatherer(packs, ["name", "around"])
        for batch in common.slices(batches, "text", SLICE_BYTES):
            flat = Flat.of(common.values(batch, "text"))
            suffixes = Suffixes(flat)
            runs = suffixes.runs()
            owner = np.searchsorted(flat.bounds, runs["first"], side="right") - 1
            begin = flat.bounds[owner]
            yield from out.add(
                {
                    "name": runs["name"],
                    "around": runs["around"],
                    "id": common.values(batch, "id").to_numpy(zero_copy_only=False)[owner],
                    "text": _text_names(batch)[owner],
                    "first": runs["first"] - begin,
                    "last": runs["last"] - begin,
                }
            )
        yield from out.flush()

    def resolved(entries: DataFrame, by: Callable, what: str) -> DataFrame:
        dealt = entries.repartition("pack").sortWithinPartitions("pack")
        return common.stored(dealt.mapInArrow(by, _FOUND_SCHEMA), what)

    found = resolved(docs.mapInArrow(deal, _PACK_SCHEMA), _resolve_runs, "runs")
    common.free_shuffles(spark)

    opened = _spans(found.where("open"))
    texts = common.likely(docs, "mark", found.where("open").select("text")).join(opened, ["id", "mark"])

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gatherer(packs, ["name"])
        for batch in common.slices(batches, "content", SLICE_BYTES):
            flat = Flat.of(common.values(batch, "content"))
            suffixes = Suffixes(flat)
            covered = np.zeros(len(suffixes.windows) + 1, dtype=np.int64)
            row, first, last = _flat_spans(batch)
            np.add.at(covered, flat.bounds[row] + first, 1)
            np.add.at(covered, flat.bounds[row] + last + 1, -1)
            at = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
            owner = np.searchsorted(flat.bounds, at, side="right") - 1
            start = at - flat.bounds[owner]
            yield from out.add(
                {
                    "name": suffixes.windows[at],
                    "around": np.zeros(len(at), dtype=np.uint64),
                    "id": common.values(batch, "id").to_numpy(zero_copy_only=False)[owner],
                    "text": _text_names(batch)[owner],
                    "first": start,
                    "last": start,
                }
            )
        yield from out.flush()

    columns = texts.select("id", "mark", F.col("text").alias("content"), "spans")
    windows = resolved(columns.mapInArrow(window, _PACK_SCHEMA), _resolve_windows, "windows")
    common.free_shuffles(spark)
    return found.where("not open").unionByName(windows).drop("open")


def _spans(found: DataFrame) -> DataFrame:
    """The spans of each text: rows that share a key without sharing the text have their own."""
    spans = F.collect_list(F.struct("first", "last")).alias("spans")
    return found.groupBy("id", F.col("text").alias("mark")).agg(spans)


def _flat_spans(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, first and last of all spans of a batch; a null list has none."""
    spans = common.values(batch, "spans")
    counts = pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    values = spans.flatten()
    row = np.repeat(np.arange(batch.num_rows), counts)
    return row, *[values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)]


def remove_repeats(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns ``keep``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes left) of every row.

    A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller
    key, or earlier in the same text. Strings never cross texts and are judged on the input.
    A null text is empty, a null key the smallest; texts of one key are ordered by a hash, and rows
    that share key and text are one document, with one result. Very long texts are handled whole.
    """
    kept = F.struct(*keep).alias("_kept")
    source = docs.select(kept, F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("mark", F.xxhash64("text"))
    spans = _spans(repeats(source.select("id", "mark", "text")))
    joined = source.withColumnRenamed("text", "content").join(spans, ["id", "mark"], "left").drop("id", "mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "content"):
            flat = Flat.of(common.values(batch, "content"))
            row, first, last = _flat_spans(batch)
            change = np.zeros(len(flat.data) + 1, dtype=np.int64)
            np.add.at(change, flat.bounds[row] + first, 1)
            np.add.at(change, flat.bounds[row] + last + LENGTH, -1)
            gone = np.cumsum(change[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            starts = flat.bounds[:-1]
            inner = starts[starts < len(gone)]
            begins[inner] = gone[inner]
            total = np.concatenate([[0], np.cumsum(gone)])
            runs = np.concatenate([[0], np.cumsum(begins)])
            removed = total[flat.bounds[1:]] - total[flat.bounds[:-1]]
            left = flat.data[~gone].tobytes()
            ends = flat.bounds - total[flat.bounds]
            rest = [left[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    common.values(batch, "_kept"),
                    pa.array(np.diff(flat.bounds)),
                    pa.array(removed),
                    pa.array(runs[flat.bounds[1:]] - runs[flat.bounds[:-1]]),
                    pa.array(rest, pa.binary()),
                ],
                names=["_kept", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    shape = joined.schema["_kept"].dataType.simpleString()
    done = joined.mapInArrow(run, f"_kept {shape}, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select("_kept.*", "n_bytes", "n_removed", "n_spans", "kept")


def _decoded(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: b.decode("utf-8", "ignore"))


def readable(kept: str) -> Column:
    """A column of bytes as text; characters that lost some of their bytes are left out."""
    return F.pandas_udf(_decoded, "string")(kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: A window for every byte of a large table is out of reach of SQL; tests compare with brute force.
ORACLE = None
