"""Alignment of two tokenizers: which tokens of one cover which tokens of the other, and how often in the corpus.

Both token sequences of a text spell the same bytes. Where tokens of both end at the same byte, the
text falls into groups; tokens whose bytes overlap are linked. How many documents hold a pair of linked ids
is counted outside memory, as an external sort does:

* A task collects pair-document records until a buffer is full, sorts them by pair (first side first), deals them
  out by a radix digit of the first id, and writes one zstd-compressed run per digit: its distinct pairs, the
  number of documents of each, and the documents themselves.
* The runs of a digit are merged by a heap. Equal pairs follow each other and add up; pairs of one first id
  follow each other as well, so its highest count is known when the next id comes. Where a digit has more runs
  than a merge takes, groups of them are merged first.
* The counts meet the runs of their digit once more, and each run streams back what its pairs
  bring to its documents.

Everything that moves is a compressed run of bounded size. A digit with very many records is spread over
several tasks on the way back.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common, tokens

FIRST = "byte_bpe_50k.json"
SECOND = "piece_bpe_32k.model"
#: Runs per buffer: the last bits of the first id.
RADIX = 256
#: Records and documents that a buffer holds.
RECORDS = 1 << 20
DOCUMENTS = 1 << 14
#: Runs of a digit that are merged at once.
MERGED = 256
#: Records that one task streams back, about.
SHARE = 1 << 22
#: Words a process remembers of either tokenizer.
WORDS = 500_000
SLICE_BYTES = 1 << 20

_LEVEL = 3


def _shrunk(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=_LEVEL).compress(np.ascontiguousarray(values).tobytes())


def _grown(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=kind)


def _keys_out(keys: np.ndarray) -> bytes:
    """Sorted pairs as the differences between them."""
    return _shrunk(np.diff(keys, prepend=np.uint64(0)).astype("<u4"))


def _keys_in(blob: bytes) -> np.ndarray:
    return np.cumsum(_grown(blob, "<u4"), dtype=np.uint64)


class Pieces:
    """Ids of the second tokenizer, a SentencePiece model whose pieces hold the mark of a blank in front only.

    Blanks and line ends then start what is merged on its own, so words have the same ids anywhere and
    most come from a dictionary.
    """

    BLANK = "▁"
    _CUT = re.compile(r"\n[^ \n]*| +[^ \n]*")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(self.BLANK, " ").encode() for i, n in enumerate(names)
        ]
        self.cuts = not any(self.BLANK in n.lstrip(self.BLANK) or "\n" in n for n in names)
        # A text that is one blank would be empty to the model.
        self.alone = self.direct(["\n"])[0][:4]
        self.cache: dict[str, bytes] = {}

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, dtype="<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.direct(texts)
        if len(self.cache) > WORDS:
            self.cache.clear()
        # The model puts a blank before a text. A text with the mark itself can't be cut.
        whole = {i: self.direct([t])[0] for i, t in enumerate(texts) if self.BLANK in t}
        plain = {i: t.split(" ") for i, t in enumerate(texts) if t and i not in whole and "  " not in t and t[0] != " "}
        rest = {i: self._CUT.findall(" " + t) for i, t in enumerate(texts) if i not in whole and i not in plain}
        every = set(chain.from_iterable(plain.values()))
        # What stands between two blanks is written without the first, words with what stands before.
        cut = {w for w in chain.from_iterable(rest.values()) if w != " "}
        found = {w: self.cache[w] for w in every if w in self.cache}
        new = [w for w in every if w not in found]
        found.update(zip(new, self.direct(new)))
        self.cache.update((w, found[w]) for w in new if w and len(w) <= tokens.LONGEST)
        found[""] = self.alone
        # A blank put before a line end is a piece of its own and goes again.
        words = {w: p if w[0] == " " else p[4:] for w, p in zip(cut, self.direct([w[w[0] == " " :] for w in cut]))}
        words[" "] = self.alone
        out = [(found, plain[i]) if i in plain else (words, rest.get(i, [])) for i in range(len(texts))]
        return [whole[i] if i in whole else b"".join(map(ids.__getitem__, own)) for i, (ids, own) in enumerate(out)]


class Vocabulary:
    """The bytes of every id, one after another."""

    def __init__(self, spelled: list[bytes]):
        self.sizes = np.array([len(b) for b in spelled], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.data[np.arange(len(shift)) + shift]


def byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Aligner:
    """Both tokenizers of a process."""

    def __init__(self, first: str, second: str):
        self.first = tokens.Encoder(first, spaces=True, names=False, remembered=WORDS)
        self.second = Pieces(second)
        letters = byte_letters()
        named = self.first.tokenizer.get_vocab(with_added_tokens=False)
        spelled = [b""] * (max(named.values()) + 1)
        for name, number in named.items():
            spelled[number] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.sides = (Vocabulary(spelled), Vocabulary(self.second.bytes))
        # Decimal ids with what may follow them.
        most = max(len(spelled), len(self.second.bytes))
        self.texts = [f"{i}{mark}".encode() for i in range(most) for mark in ",|;"]

    def align(self, texts: list[str | None]) -> Aligned:
        padded = [" " + t if t else "" for t in texts]
        ids, counts = [], []
        for encoded in (self.first.encode(padded), self.second.encode([t or "" for t in texts])):
            encoded = [e if p else b"" for e, p in zip(encoded, padded)]
            counts.append(np.array([len(e) // 4 for e in encoded], dtype=np.int64))
            ids.append(np.frombuffer(b"".join(encoded), dtype="<u4").astype(np.int64))
        data = [p.encode() for p in padded]
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        expected = np.frombuffer(b"".join(data), dtype=np.uint8)
        good = sizes > 0
        for side in (0, 1):
            good &= self._spells(side, ids[side], counts[side], expected, sizes)
        for side in (0, 1):
            ids[side] = ids[side][np.repeat(good, counts[side])]
            counts[side] = np.where(good, counts[side], 0)
        return Aligned(self, ids, counts)

    def _spells(self, side: int, ids: np.ndarray, counts: np.ndarray, expected: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which texts the ids spell exactly."""
        vocabulary = self.sides[side]
        owner = np.repeat(np.arange(len(counts)), counts)
        spelled = np.bincount(owner, vocabulary.sizes[ids], minlength=len(counts)).astype(np.int64)
        same = spelled == sizes
        found = vocabulary.spell(ids[same[owner]])
        wanted = expected[np.repeat(same, sizes)]
        place = np.repeat(np.flatnonzero(same), sizes[same])
        same[place[found != wanted]] = False
        return same


class Aligned:
    """Texts as token ids of both sides: ``groups`` and ``links`` per text, and every link's text and ids."""

    def __init__(self, aligner: Aligner, ids: list[np.ndarray], counts: list[np.ndarray]):
        self.aligner, self.ids, self.counts = aligner, ids, counts
        ends = [np.cumsum(aligner.sides[side].sizes[ids[side]]) for side in (0, 1)]
        # Between two ends of any side lies exactly one token of each, so every stretch is a link. Texts follow
        # each other, and at the end of a text both sides end.
        cuts = np.sort(np.concatenate(ends))
        self.cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])] if len(cuts) else cuts
        at = [np.searchsorted(ends[side], self.cuts) for side in (0, 1)]
        self.pairs = (ids[0][at[0]].astype(np.uint64) << np.uint64(16)) | ids[1][at[1]].astype(np.uint64)
        common_ends = np.intersect1d(*ends, assume_unique=True)
        self.group = [np.searchsorted(common_ends, ends[side]) for side in (0, 1)]
        owners = np.repeat(np.arange(len(counts[0])), counts[0])
        self.texts = owners[at[0]]
        last = np.searchsorted(ends[0], common_ends)
        self.links = np.bincount(self.texts, minlength=len(counts[0]))
        self.groups = np.bincount(owners[last], minlength=len(counts[0]))

    def digests(self) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each text, hashed; empty for a text without tokens."""
        import hashlib

        a, b = self.group
        n = int(a[-1]) + 1 if len(a) else 0
        size_a, size_b = np.bincount(a, minlength=n), np.bincount(b, minlength=n)
        before = np.cumsum(size_a + size_b) - size_a - size_b
        place_a = before[a] + np.arange(len(a)) - (np.cumsum(size_a) - size_a)[a]
        place_b = before[b] + size_a[b] + np.arange(len(b)) - (np.cumsum(size_b) - size_b)[b]
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[place_a] = self.ids[0] * 3 + (np.append(a[1:], -1) != a)
        code[place_b] = self.ids[1] * 3 + 2 * (np.append(b[1:], -1) != b)
        texts = self.aligner.texts
        found, start = [], 0
        codes = code.tolist()
        for count in (self.counts[0] + self.counts[1]).tolist():
            own = b"".join([texts[c] for c in codes[start : start + count]])
            found.append(hashlib.sha256(own[:-1]).hexdigest() if count else "")
            start += count
        return found


_aligners: dict[tuple[str, str], Aligner] = {}
common.LEFTOVERS.append(_aligners.clear)


def aligner(first: str, second: str) -> Aligner:
    """The process's tokenizers."""
    if (first, second) not in _aligners:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


class Buffer:
    """Pair-document records until they are written as runs."""

    def __init__(self, key_type: pa.DataType, records: int = RECORDS, documents: int = DOCUMENTS):
        self.key_type, self.most = key_type, (records, documents)
        self.number = 0
        self._clear()

    def _clear(self) -> None:
        self.records: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, keys: list, found: Aligned) -> None:
        record = (found.pairs << np.uint64(32)) | (found.texts + len(self.rows)).astype(np.uint64)
        record = np.sort(record)
        first = np.flatnonzero(np.concatenate([[True], record[1:] != record[:-1]])) if len(record) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.append(first, len(record)))
        record = record[first]
        self.records.append(record)
        self.times.append(times.astype("<u4"))
        self.held += len(record)
        self.rows += zip(keys, *(x.tolist() for x in found.counts), found.groups.tolist(), found.links.tolist(), found.digests())

    @property
    def full(self) -> bool:
        return self.held >= self.most[0] or len(self.rows) >= self.most[1]

    def runs(self) -> Iterator[pa.RecordBatch]:
        """The documents and one run per digit, as rows; the buffer is empty afterwards."""
        if not self.rows:
            return
        buffer = (TaskContext.get().partitionId() << 32) | self.number
        self.number += 1
        record, times = np.concatenate(self.records), np.concatenate(self.times)
        order = np.argsort(record, kind="stable")
        record, times = record[order], times[order]
        pairs, texts = record >> np.uint64(32), (record & np.uint64(0xFFFFFFFF)).astype("<u4")
        digit = ((pairs >> np.uint64(16)) % np.uint64(RADIX)).astype(np.int64)
        order = np.argsort(digit, kind="stable")
        bounds = np.searchsorted(digit[order], np.arange(RADIX + 1))
        keys, a, b, groups, links, digests = zip(*self.rows)
        batch = {name: [] for name in ("radix", "records", "pairs", "counts", "texts", "times")}
        for r in range(RADIX):
            own = order[bounds[r] : bounds[r + 1]]
            if len(own):
                distinct, counts = np.unique(pairs[own], return_counts=True)
                row = (r, len(own), _keys_out(distinct), _shrunk(counts.astype("<u4")), _shrunk(texts[own]), _shrunk(times[own]))
                for name, value in zip(batch, row):
                    batch[name].append(value)
        n = len(batch["radix"])
        columns = {"buffer": [buffer] * (n + 1), **{name: [*values, None] for name, values in batch.items()}}
        columns["records"][-1] = len(self.rows)
        arrays = {name: pa.array(v, _RUNS[name]) for name, v in columns.items()}
        documents = {"keys": (keys, self.key_type), "digests": (digests, pa.string())}
        documents |= {k: (v, pa.int64()) for k, v in (("n_a", a), ("n_b", b), ("n_groups", groups), ("n_links", links))}
        arrays |= {name: pa.array([None] * n + [list(v)], pa.list_(kind)) for name, (v, kind) in documents.items()}
        self._clear()
        yield pa.RecordBatch.from_pydict({name: arrays[name] for name in [*_RUNS, *_DOCUMENTS]})


_RUNS = {
    "buffer": pa.int64(), "radix": pa.int32(), "records": pa.int64(), "pairs": pa.binary(), "counts": pa.binary(),
    "texts": pa.binary(), "times": pa.binary(),
}
_DOCUMENTS = ("keys", "n_a", "n_b", "n_groups", "n_links", "digests")


def write_runs(docs: DataFrame, key: str, text: str, first: str, second: str, records: int, documents: int) -> DataFrame:
    """Runs (``radix`` is set) and documents (it is not) of all texts, written to the shared folder."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, tool = None, aligner(first, second)
        for batch in common.slices(batches, "text", SLICE_BYTES, remember=True):
            buffer = buffer or Buffer(common.values(batch, "key").type, records, documents)
            buffer.add(common.values(batch, "key").to_pylist(), tool.align(common.values(batch, "text").to_pylist()))
            if buffer.full:
                yield from buffer.runs()
        if buffer:
            yield from buffer.runs()

    schema = (
        "buffer long, radix int, records long, pairs binary, counts binary, texts binary, times binary, "
        f"keys array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>"
    )
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return common.stored(rows.mapInArrow(run, schema), "runs")


def merged(runs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """Pairs in order and their counts over all sorted runs, by a heap with one entry per run."""
    streams = [zip(pairs.tolist(), counts.tolist()) for pairs, counts in runs]
    pair, total = -1, 0
    for key, count in heapq.merge(*streams):
        if key != pair:
            if total:
                yield pair, total
            pair, total = key, 0
        total += count
    if total:
        yield pair, total


def highest(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of their first id. Pairs are in order, so an id's follow each other."""
    first = pairs >> np.uint64(16)
    starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    most = np.maximum.reduceat(counts, starts)
    return counts == np.repeat(most, np.diff(np.append(starts, len(pairs))))


def _dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows of equal ``by`` in one task, one after another."""
    return rows.repartition(*by).sortWithinPartitions(*by, *order)


def merge_runs(runs: DataFrame, at_once: int = MERGED) -> DataFrame:
    """Per digit: its pairs and in how many documents each is. Levels of merges where there are many runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            found = list(merged(held))
            pairs = np.array([p for p, _ in found], dtype=np.uint64)
            counts = np.array([c for _, c in found], dtype="<u8")
            row = (at, _keys_out(pairs), _shrunk(counts))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.binary(), pa.binary()))], names=["radix", "pairs", "counts"]
            )

        last = None
        for batch in batches:
            for radix, group, pairs, counts, wide in zip(*(common.values(batch, n).to_pylist() for n in ("radix", "group", "pairs", "counts", "wide"))):
                if (radix, group) != last and held:
                    yield out()
                    held = []
                at, last = radix, (radix, group)
                held.append((_keys_in(pairs), _grown(counts, "<u8" if wide else "<u4")))
        if held:
            yield out()

    level = runs.select("radix", F.xxhash64("buffer").alias("mark"), "pairs", "counts", F.lit(False).alias("wide"))
    while True:
        most = level.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
        groups = -(-most // at_once) if most > at_once else 1
        dealt = _dealt(level.withColumn("group", F.pmod("mark", F.lit(groups))), ["radix", "group"], [])
        done = dealt.select("radix", "group", "pairs", "counts", "wide").mapInArrow(run, "radix int, pairs binary, counts binary")
        done = common.stored(done, "merged")
        if groups == 1:
            return done
        level = done.select("radix", F.xxhash64("pairs", "counts").alias("mark"), "pairs", "counts", F.lit(True).alias("wide"))


def contributions(runs: DataFrame, totals: DataFrame, share: int = SHARE) -> DataFrame:
    """Per buffer and task, what the pairs bring to the documents of the buffer: two numbers each, compressed.

    A digit's counts go first to each task that reads runs of it. Digits with many records are read by
    several tasks.
    """
    sizes = runs.groupBy("radix").agg(F.sum("records").alias("n"))
    # One row per digit.
    parts = sizes.select("radix", F.ceil(F.col("n") / share).cast("int").alias("parts"))
    nothing = F.lit(None).cast("binary")
    back = runs.join(parts, "radix").select(
        "radix", F.pmod(F.xxhash64("buffer"), F.col("parts")).cast("int").alias("part"), "buffer", "pairs", "counts", "texts", "times"
    )
    copies = totals.join(parts, "radix").select(
        "radix", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("buffer"),
        "pairs", "counts", nothing.alias("texts"), nothing.alias("times"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = None, None, None
        sums: dict[int, np.ndarray] = {}
        held = 0

        def out() -> pa.RecordBatch:
            blobs = [_shrunk(np.concatenate([v[0], v[1]]).astype("<i8")) for v in sums.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(blobs, pa.binary())], names=["buffer", "sums"])

        for batch in batches:
            for buffer, own, own_counts, texts, times in zip(*(common.values(batch, n).to_pylist() for n in ("buffer", "pairs", "counts", "texts", "times"))):
                if buffer < 0:
                    pairs, counts = _keys_in(own), _grown(own_counts, "<u8").astype(np.int64)
                    best = highest(pairs, counts)
                    continue
                at = np.repeat(np.searchsorted(pairs, _keys_in(own)), _grown(own_counts, "<u4"))
                texts, times = _grown(texts, "<u4").astype(np.int64), _grown(times, "<u4").astype(np.int64)
                size = int(texts.max()) + 1
                known = sums.get(buffer, np.zeros((2, 0), dtype=np.int64))
                if known.shape[1] < size:
                    held += size - known.shape[1]
                    known = np.pad(known, ((0, 0), (0, size - known.shape[1])))
                np.add.at(known[0], texts, np.where(best[at], times, 0))
                np.add.at(known[1], texts, counts[at] * times)
                sums[buffer] = known
                if held > 1 << 20:
                    yield out()
                    sums, held = {}, 0
        if sums:
            yield out()

    return _dealt(back.unionByName(copies), ["radix", "part"], ["buffer"]).select(
        "buffer", "pairs", "counts", "texts", "times"
    ).mapInArrow(run, "buffer long, sums binary")


def align(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    first: str | None = None,
    second: str | None = None,
    records: int = RECORDS,
    documents: int = DOCUMENTS,
    at_once: int = MERGED,
    share: int = SHARE,
) -> DataFrame:
    """Per row: numbers of tokens, groups and links, links with their first id's highest count, sum of counts, digest of the groups.

    A text that is null, empty, or not spelled by either side's ids has no tokens: zeros, and an empty digest.
    Null and repeated keys are rows of their own, and each counts as a document. Texts are read whole; a text
    of any length is one set of records. An empty table gives no rows. Other columns are not read.
    """
    first, second = first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND)
    kind = docs.schema[key].dataType.simpleString()
    held = write_runs(docs, key, text, first, second, records, documents)
    runs = held.where("radix is not null").select("buffer", "radix", "records", "pairs", "counts", "texts", "times")
    totals = merge_runs(runs, at_once)
    sums = contributions(runs, totals, share)
    rows = held.where("radix is null").select("buffer", F.lit(None).cast("binary").alias("sums"), *_DOCUMENTS)
    empty = [F.lit(None).cast(held.schema[n].dataType).alias(n) for n in _DOCUMENTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, total = None, None

        def out() -> pa.RecordBatch:
            values = [common.values(row, n).flatten() for n in _DOCUMENTS]
            found = [*values[:5], pa.array(total[0]), pa.array(total[1]), values[5]]
            return pa.RecordBatch.from_arrays(found, names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        for batch in batches:
            blobs = common.values(batch, "sums").to_pylist()
            for i, blob in enumerate(blobs):
                if blob is None:
                    if row is not None:
                        yield out()
                    row = batch.slice(i, 1)
                    total = np.zeros((2, len(common.values(row, "digests").flatten())), dtype=np.int64)
                else:
                    part = _grown(blob, "<i8").reshape(2, -1)
                    total[:, : part.shape[1]] += part
        if row is not None:
            yield out()

    both = rows.unionByName(sums.select("buffer", "sums", *empty))
    # The documents of a buffer (no sums) stand before what comes back to them.
    done = _dealt(both, ["buffer"], ["sums"]).select("sums", *_DOCUMENTS)
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return done.mapInArrow(run, schema).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"))


#: Tokenizers are not expressible in SQL; tests compare with a brute-force version.
ORACLE = None
