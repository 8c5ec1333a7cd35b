"""Union-find over edges that never leave the executors.

Alternating star contractions: each node hands its larger (then its smaller) neighbours to
the smallest node it knows, until every node hangs directly below the smallest one of its
component. A star is one aggregation and one join, so a node with very many neighbours is
split by adaptive execution like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("root").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").where("b != root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    own = least.select("a", F.col("root").alias("b"))
    return moved.unionByName(own).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node but the roots.

    Loops and null ends are ignored. Each round is written to the shared folder.
    """
    edges = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b").distinct()
    edges = common.stored(edges, "edges")
    mark = None
    while True:
        edges = common.stored(_small_star(_large_star(edges)), "stars")
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (state.n, state.h) == mark or state.n == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = (state.n, state.h)
