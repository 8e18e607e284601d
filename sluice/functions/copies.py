"""Numbering of equal rows, of which one may have very many."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CHUNK = 10_000


def number_copies(df: DataFrame, name: str = "copy", chunk: int = CHUNK) -> DataFrame:
    """``df`` with the copies of each row numbered from 1; null equals null and NaN equals NaN.

    Equal rows are counted, before the shuffle already, and made again from their count: first one row for each
    ``chunk`` copies, dealt anew, then the copies of a chunk. No task sees more than it makes, however often a row
    occurs, and the numbers do not depend on how rows were placed.
    """
    counts = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counts.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
    dealt = chunks.repartition(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col("_chunk"))
    last = F.least(F.col("_n"), (F.col("_chunk") + 1) * chunk)
    return dealt.withColumn(name, F.explode(F.sequence(F.col("_chunk") * chunk + 1, last))).drop("_n", "_chunk")
