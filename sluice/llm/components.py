"""Connected components of links, by rounds of joins whose results are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.workdir import materialize


def components(links: DataFrame, name: str = "links", most_rounds: int = 100) -> DataFrame:
    """(node, root) for each node of ``links`` (its first two columns); root is the least node it reaches.

    Rounds of large and small stars: each node hands its larger neighbours, then all its neighbours, to the least
    one. The number of rounds grows with the logarithm of the longest chain. Minima are aggregated before the
    shuffle and a node's links meet its minimum in a join that adaptive execution can split, so a hub with very
    many links is no single task. Each round is written once; nothing but two numbers reaches the driver.
    Links with a null end and links of a node to itself are ignored; no links give no rows.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    now = _written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), a.isNull().alias("x"), b.isNull().alias("y"))
                        .where("not x and not y and u != v").select("u", "v"), name)
    before = _mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(least.withColumnRenamed("m", "v")))
        now = _written(small, name)
        after = _mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _written(links: DataFrame, name: str) -> DataFrame:
    return materialize(links.distinct(), name)


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
