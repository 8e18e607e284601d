"""Exact ranks and exact-size samples in hash order, without one task per group.

Rows of a group are ordered by an md5 of seed and key. The first 16 bits of the hash
cut every group, however large, into up to 65 536 even parts; counts of those parts
give each part's offset, and ranks are taken inside parts only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sluice import workdir


def key_hash(seed: int, keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("~")) for k in keys]))


def _hashed(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    return (df.withColumn("_h", key_hash(seed, keys))
            .withColumn("_part", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")))


def _offsets(hashed: DataFrame, group: str) -> DataFrame:
    counts = hashed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy("_part")
    return counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def with_group_rank(df: DataFrame, group: str, keys: Sequence[str], seed: int, rank: str = "rank") -> DataFrame:
    """Adds each row's 1-based rank within its group, in hash order."""
    rows = _hashed(df, keys, seed)
    offsets = _offsets(rows, group).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_before")
    w = Window.partitionBy(group, "_part").orderBy("_h", *keys)
    ranked = rows.withColumn("_rn", F.row_number().over(w))
    joined = ranked.join(offsets, _same(F.col(group), F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(rank, F.col("_before") + F.col("_rn")).drop("_h", "_part", "_rn", "_g", "_p", "_before")


def mark_quota(df: DataFrame, group: str, quotas: Mapping, keys: Sequence[str], seed: int,
               flag: str = "taken") -> DataFrame:
    """Flags exactly ``quotas[g]`` rows of each group g (all of them if it has fewer).

    Counts of the parts give each group's border part: parts before it are taken whole, parts after it not at all,
    and only rows of the border part are ranked. The table of borders has one row per group and is written before
    it is joined, so its size decides how.
    """
    rows = _hashed(df, keys, seed)
    kind = df.schema[group].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame([(g, int(q)) for g, q in quotas.items()], f"_g {kind}, _quota long")
    short = (_offsets(rows, group).join(wanted, F.col(group) == F.col("_g"))
             .where(F.col("_before") + F.col("_n") > F.col("_quota"))
             .groupBy("_g").agg(F.min(F.struct("_part", "_before")).alias("_first")))
    borders = wanted.join(short.withColumnRenamed("_g", "_s"), F.col("_g") == F.col("_s"), "left").select(
        "_g", F.coalesce("_first._part", F.lit(1 << 16)).alias("_border"),
        (F.col("_quota") - F.coalesce("_first._before", F.lit(0))).alias("_need"))
    split = rows.join(workdir.materialize(borders, "quota-borders"), F.col(group) == F.col("_g"), "left")
    inside = F.col("_border").isNotNull() & (F.col("_part") == F.col("_border"))
    w = Window.partitionBy(group, "_part").orderBy("_h", *keys)
    edge = split.where(inside).withColumn(flag, F.row_number().over(w) <= F.col("_need"))
    sure = split.where(~inside).withColumn(flag, F.coalesce(F.col("_part") < F.col("_border"), F.lit(False)))
    return sure.unionByName(edge).drop("_h", "_part", "_g", "_border", "_need")


def take_quota(df: DataFrame, group: str, quotas: Mapping, keys: Sequence[str], seed: int) -> DataFrame:
    return mark_quota(df, group, quotas, keys, seed, "_taken").where("_taken").drop("_taken")


def group_counts(df: DataFrame, group: str) -> dict:
    """Rows per group on the driver: one entry per class of a label column."""
    return {r[0]: r[1] for r in df.groupBy(group).count().collect()}
