"""Order tables as case records: the mapping behind every registered query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions import text


# Columns and types of the tables every query reads. With them Spark opens no
# file to infer a schema before the query starts.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def stamps(spark: SparkSession, sf_dir: str) -> tuple[tuple[int, int, int], ...]:
    """What tells whether the tables changed: time of change, bytes and number of files of each, by one look per table."""
    found = []
    for name in SCHEMAS:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        size = files.getContentSummary(path)
        found.append((files.getFileStatus(path).getModificationTime(), size.getLength(), size.getFileCount()))
    return tuple(found)


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: nation is the outer segment, market segment the inner one.

    Joins carry no hints. Spark broadcasts the nations because their file size
    is under its threshold, and shuffles customers once they outgrow it.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_orderdate").cast("date").alias("received_at"),
        F.col("o_orderstatus").alias("area"),
        F.col("o_totalprice").alias("value"),
        "o_custkey",
    )
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", text.strip(F.col("c_mktsegment")).alias("unit")
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", text.group_name(F.col("n_name")).alias("district"))
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations, F.col("c_nationkey") == nations.n_nationkey
    )
    records = joined.select("case_id", "received_at", "district", "unit", "area", "value")
    return records.dropna(subset=["district", "unit"])
