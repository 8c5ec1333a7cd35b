"""From documents to packed training sequences; each stage calls one operator.

A stage gets all rows that its predecessor kept and returns the columns of ``documents``; the
last returns pieces with their token ids. Between stages rows are written and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import common, op2_near_dups, op3_language, op4_repeats, op6_mixing, op7_packing

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters, or unlike all languages, go."""
    common.small_batches(spark)
    identifier = op3_language.fit(docs.where(~op3_language.fold()))
    # Texts go to Python once and do not come back: what is rejected is found by a hash of the row.
    mark = F.xxhash64("doc_id", "text")
    rows = docs.select(mark.alias("mark"), "text")
    gone = op3_language.identify(rows, identifier, keep=["mark"]).where("rejected").select("mark").distinct()
    gone = common.stored(gone, "rejected")
    return docs.withColumn("_mark", mark).join(gone, F.col("_mark") == gone["mark"], "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id.

    Rows that share an id are one document; documents without an id stay.
    """
    common.small_batches(spark)
    gone = op2_near_dups.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that stand earlier in the corpus; a text may end up empty."""
    common.small_batches(spark)
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(*rest).alias("row"), "doc_id", "text")
    done = op4_repeats.remove_repeats(rows, ["row"]).select("row.*", op4_repeats.readable("kept").alias("text"))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions: documents are repeated, cut or left out as the mix says."""
    common.small_batches(spark)
    return op6_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of 1024."""
    common.small_batches(spark)
    return op7_packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dups", near_duplicates),
    ("suffix_dedup", repeats),
    ("mixing", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language models and tokenizers are not expressible in SQL. Tests hold the operators against brute force; of the chain they check rows, ids and lengths.
ORACLE_SQL = None
