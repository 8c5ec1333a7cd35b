"""Token ids in directly addressable codes.

An id is split into chunks of eight bits. The first chunk of every id is on the first level;
where more chunks follow, a bit is set and the next chunk stands on the next level, at the
place given by the number of bits set before. A directory of such numbers for every 512 bits
makes that a constant-time lookup: any token of a block is read without decoding others.

Blocks are rows of Parquet files, so they are written and committed by Spark in any store; the files
follow the order of the keys, and a manifest tells how many ids stand before each file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common, tokens

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: A block is closed when it holds so many ids; a document is never split.
BLOCK_IDS = 1 << 16
RANK_BITS = 512


def pack(values: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories, one of each per level."""
    chunks, bitmaps, ranks = [], [], []
    rest = values.astype(np.uint32)
    while True:
        chunks.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        before = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BITS)))]) if len(more) else [0]
        bitmaps.append(bits.tobytes())
        ranks.append(np.asarray(before[:-1] if len(more) else before, dtype="<u4").tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            return chunks, bitmaps, ranks


def unpack(chunks: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a block."""
    found = np.zeros(0, dtype=np.uint32)
    for level in range(len(chunks) - 1, -1, -1):
        own = np.frombuffer(chunks[level], dtype=np.uint8).astype(np.uint32)
        if level + 1 < len(chunks):
            more = np.unpackbits(np.frombuffer(bitmaps[level], dtype=np.uint8), count=len(own), bitorder="little")
            own[more.view(bool)] |= found << 8
        found = own
    return found


def token_at(chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes], place: int) -> int:
    """One id of a block, by its place; reads one chunk, bit and rank per level."""
    value = 0
    for level, chunk in enumerate(chunks):
        value |= chunk[place] << (8 * level)
        bits = bitmaps[level]
        if not bits[place >> 3] >> (place & 7) & 1:
            break
        first = place // RANK_BITS
        start = first * RANK_BITS // 8
        before = int.from_bytes(bits[start : place >> 3], "little").bit_count()
        before += (bits[place >> 3] & ((1 << (place & 7)) - 1)).bit_count()
        place = int.from_bytes(ranks[level][4 * first : 4 * first + 4], "little") + before
    return value


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
    key: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode every text, append ``end_id``, and write ``path/blocks`` and ``path/manifest``.

    Documents stand in ascending order of the key, nulls first, ties by text. A null text counts as
    empty and has the end id only. Extra columns are not read. Texts are dealt out by ranges
    of the key once; the manifest has one row per range.
    """
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    end = np.array([end_id], dtype="<u4").tobytes()
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"range int, start_in_range long, n_ids long, keys array<{kind}>, counts array<long>, "
        "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer, spaces=False).encode
        number, start = TaskContext.get().partitionId(), 0
        keys: list = []
        packed: list[bytes] = []
        held, of = 0, None

        def block() -> pa.RecordBatch:
            nonlocal keys, packed, held, start
            counts = [len(p) // 4 for p in packed]
            chunks, bitmaps, ranks = pack(tokens.ids(b"".join(packed)))
            row = pa.RecordBatch.from_pydict(
                {
                    "range": pa.array([number], pa.int32()),
                    "start_in_range": [start],
                    "n_ids": [held],
                    "keys": pa.array([keys], pa.list_(of)),
                    "counts": pa.array([counts], pa.list_(pa.int64())),
                    **{n: pa.array([v], pa.list_(pa.binary())) for n, v in (("chunks", chunks), ("bitmaps", bitmaps), ("ranks", ranks))},
                }
            )
            start, keys, packed, held = start + held, [], [], 0
            return row

        for batch in common.slices(batches, "text", remember=True):
            of = common.values(batch, "key").type
            for own, p in zip(common.values(batch, "key").to_pylist(), encode(common.values(batch, "text"))):
                keys.append(own)
                packed.append(p + end)
                held += len(p) // 4 + 1
                if held >= block_ids:
                    yield block()
        if keys:
            yield block()

    ranged = source.repartitionByRange("key").sortWithinPartitions("key", "text")
    ranged.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")
    blocks = docs.sparkSession.read.parquet(f"{path}/blocks")
    ranges = blocks.groupBy("range").agg(F.sum("n_ids").alias("n_ids"))
    common.prefix_sums(ranges, "range", "n_ids", "ids_before").write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Key, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (little-endian 32-bit) from the files.

    ``last_id`` is a document's last id, read alone through the rank directories (null without ids).
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    manifest = spark.read.parquet(f"{path}/manifest").select("range", "ids_before")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    starts = blocks.join(manifest, "range").withColumn("start", F.col("ids_before") + F.col("start_in_range"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                chunks, bitmaps, ranks = (common.values(row, n).to_pylist()[0] for n in ("chunks", "bitmaps", "ranks"))
                whole = unpack(chunks, bitmaps).astype("<u4").tobytes()
                counts = np.array(common.values(row, "counts").to_pylist()[0], dtype=np.int64)
                ends = np.cumsum(counts)
                begin = common.values(row, "start").to_pylist()[0] + ends - counts
                parts = [whole[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                last = [token_at(chunks, bitmaps, ranks, e - 1) if n else None for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        common.values(row, "keys").flatten(), pa.array(begin), pa.array(counts),
                        pa.array(parts, pa.binary()), pa.array(last, pa.int64()),
                    ],
                    names=["key", "start", "n_tokens", "ids", "last_id"],
                )

    columns = starts.select("start", "keys", "counts", "chunks", "bitmaps", "ranks")
    schema = f"key {kind}, start long, n_tokens long, ids binary, last_id long"
    return columns.mapInArrow(run, schema).withColumnRenamed("key", key)


def look_up(wanted: DataFrame, path: str, key: str = "doc_id", place: str = "place") -> DataFrame:
    """The ids at given places of documents, without decoding any block: (key, place, start, id).

    ``wanted`` names keys and places from 0, a null key included. Repeated wishes are answered once, a place outside its
    document not at all; documents that share a key are answered each, told apart by ``start``. Keys are
    found in the blocks' lists of keys alone; then each wish meets its block's codes in one group, which
    holds at most one wish per id of a block. Extra columns of ``wanted`` are not read.
    """
    spark = wanted.sparkSession
    blocks = spark.read.parquet(f"{path}/blocks")
    manifest = spark.read.parquet(f"{path}/manifest").select("range", "ids_before")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    each = blocks.select("range", "start_in_range", F.posexplode(F.arrays_zip("keys", "counts")).alias("at", "doc"), "counts")
    before = F.aggregate(F.slice("counts", 1, F.col("at")), F.lit(0).cast("long"), lambda a, n: a + n)
    docs = each.select("range", "start_in_range", F.col("doc.keys").alias("key"), F.col("doc.counts").alias("n"), before.alias("before"))
    wishes = wanted.select(F.col(key).cast(kind).alias("wish"), F.col(place).cast("long").alias("place")).distinct()
    met = docs.join(wishes, F.col("key").eqNullSafe(F.col("wish")) & (F.col("place") >= 0) & (F.col("place") < F.col("n")))
    met = met.select("range", "start_in_range", "key", "place", "before")

    def answer(asked: pa.Table, codes: pa.Table) -> pa.Table:
        places = (np.asarray(asked["before"]) + np.asarray(asked["place"])).tolist()
        if places:
            block = [codes[n][0].as_py() for n in ("chunks", "bitmaps", "ranks")]
            places = [token_at(*block, p) for p in places]
        found = asked.select(["range", "start_in_range", "key", "place", "before"])
        return found.append_column("id", pa.array(places, pa.int64()))

    # Read anew: a second reference to the same rows would make the columns of both sides ambiguous.
    asked_for = met.select(F.col("range").alias("of_range"), F.col("start_in_range").alias("of_start")).distinct()
    codes = spark.read.parquet(f"{path}/blocks").select("range", "start_in_range", "chunks", "bitmaps", "ranks")
    same = (F.col("range") == F.col("of_range")) & (F.col("start_in_range") == F.col("of_start"))
    codes = codes.join(asked_for, same, "left_semi")
    by = ("range", "start_in_range")
    schema = f"range int, start_in_range long, key {kind}, place long, before long, id long"
    found = met.groupBy(*by).cogroup(codes.groupBy(*by)).applyInArrow(answer, schema)
    start = (F.col("ids_before") + F.col("start_in_range") + F.col("before")).alias("start")
    return found.join(manifest, "range").select(F.col("key").alias(key), F.col("place").alias(place), start, "id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_folder(spark, "codes")
    write(common.table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "last_id")


#: Tokenizers are not expressible in SQL; tests compare with direct encoding.
ORACLE = None
