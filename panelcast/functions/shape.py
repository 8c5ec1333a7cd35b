"""Turning wide aggregate rows into long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, rows: list[dict[str, Column]], keep: tuple[str, ...] = ()) -> DataFrame:
    """One output row per entry of ``rows`` for every input row (few: aggregates).

    An aggregate that computes all results side by side reads its input once;
    this gives each result its own row afterwards.
    """
    structs = [F.struct(*[column.alias(name) for name, column in row.items()]) for row in rows]
    unfolded = df.select(*keep, F.explode(F.array(*structs)).alias("_row"))
    return unfolded.select(*keep, *[F.col(f"_row.{name}").alias(name) for name in rows[0]])
