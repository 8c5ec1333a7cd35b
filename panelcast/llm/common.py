"""What the operators share: tables, the shared folder, written intermediate results."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir

#: ASCII white space; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that a task works on at once. Bounds a task's memory, never changes results.
SLICE_BYTES = 1 << 20

#: Rows of an Arrow batch between executor and Python worker where a session leaves Spark's default of 10,000.
BATCH_ROWS = 1024

#: Ways to drop what tasks of a Python worker remember for those after them.
LEFTOVERS: list[Callable[[], None]] = []


#: The C library's way to return freed memory to the system, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder of the session (``spark.checkpoint.dir``)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files.

    The result keeps no lineage: a lost executor costs a read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Have tasks exchange rows with Python in batches of ``BATCH_ROWS``. Results do not depend on it.

    A batch exists several times, in the executor's direct memory and in the worker's, and texts are
    long. A smaller number set by the session stays.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(setting))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted before the next large shuffle is written.

    Spark deletes them once the driver has collected the plans that made them: Python lets go
    of its references first, and what the first collection uncovers goes with the second.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def prefix_sums(blocks: DataFrame, order: str, value: str, into: str, groups: list[str] | None = None) -> DataFrame:
    """Add the sum of ``value`` over the rows before each row.

    Meant for a table with one row per task (and group), never for one with a row per document.
    """
    from pyspark.sql import Window

    along = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(order)
    before = F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn(into, F.coalesce(before, F.lit(0)).cast("long"))


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, remember: bool = False
) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds at most ``limit`` bytes, one row at least.

    Without ``remember`` the worker first drops what earlier tasks left in it.
    """
    if not remember:
        for drop in LEFTOVERS:
            drop()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(data), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    # What the task no longer needs goes back, so idle workers stay small.
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def values(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: Bits of the pre-filter of :func:`likely`, and bits per row of its table (what Spark's bitmap functions use).
FILTER_BITS = 1 << 23
BITMAP_BITS = 32768


def likely(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``wanted`` (one column); none of it is lost.

    A bitmap of hashes of fixed size (1 MB) is broadcast, so wide rows that a join would throw away
    are not shuffled for it. With very many wanted values it passes more rows, and the exact
    join that has to follow does more of the work.
    """
    name = wanted.columns[0]
    place = F.pmod(F.xxhash64(F.col(name)), F.lit(FILTER_BITS))
    bits = wanted.select(place.alias("_place")).groupBy(F.expr(f"_place div {BITMAP_BITS}").alias("_row"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("_place") % BITMAP_BITS).alias("_bits"))
    probed = rows.withColumn("_place", F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS)))
    probed = probed.withColumn("_row", F.expr(f"_place div {BITMAP_BITS}"))
    byte = f"cast(conv(hex(substring(_bits, cast(_place % {BITMAP_BITS} div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.expr(f"(shiftright({byte}, cast(_place % 8 as int)) & 1) = 1")
    return probed.join(F.broadcast(bits), "_row").where(hit).drop("_row", "_place", "_bits")
