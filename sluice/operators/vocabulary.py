"""One-hot encoding with vocabularies of any size: a table that is joined, and sparse vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sluice import workdir
from sluice.functions.scalars import col

SCHEMA = "column string, value string, position long"


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the values of each column as text, nulls left out. Repeats shrink before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()


def sizes(values: DataFrame) -> dict[str, int]:
    """Number of values per column."""
    return {r["column"]: r["n"] for r in values.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


def number_values(values: DataFrame, path: str) -> DataFrame:
    """Writes (column, value, position): each column's values counted from 0 in sorted order.

    Ranges of values are sorted apart; counts of the ranges say where each begins.
    """
    spark = values.sparkSession
    ranges = workdir.materialize(values.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
                                 .withColumn("_id", F.monotonically_increasing_id()), "vocabulary-ranges")
    ranges = ranges.withColumn("_range", F.shiftright("_id", 33))
    parts = ranges.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    w = Window.partitionBy("column").orderBy("_range")
    starts = parts.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    placed = ranges.join(starts, ["column", "_range"]).withColumn("position", F.col("_before") + F.col("_id") - F.col("_first"))
    placed.select("column", "value", "position").write.parquet(path)
    return read(spark, path)


def fit(df: DataFrame, columns: Sequence[str], path: str | None = None) -> DataFrame:
    """The vocabulary of ``columns``, written to ``path`` (by default in the shared folder)."""
    return number_values(distinct_values(df, columns), path or workdir.new_path(df.sparkSession, "vocabulary"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def with_vector(df: DataFrame, vocabulary: DataFrame, values: Mapping[str, Column], counts: Mapping[str, int], out: str,
                dense: Sequence[Column] = ()) -> DataFrame:
    """Adds to each row the sparse vector ``out``: the ``dense`` values, then one-hot slots of ``values[c]`` for each column c.

    Null and values unknown to the vocabulary give all zeros; a column without any value has one slot that stays zero.
    A value of the vocabulary is one row, so that a value with very many rows is split by adaptive execution. The vectors
    are made without a name for each slot, which Spark's encoder and assembler would keep in the driver.
    """
    held, n_dense = df.columns, len(dense)
    rows = df.withColumns({f"_value_{i}": v for i, v in enumerate(values.values())} | {"_dense": F.array(*dense).cast("array<double>")})
    begin, slots = n_dense, []
    for i, c in enumerate(values):
        known = vocabulary.where(F.col("column") == c).select(F.col("value").alias(f"_known_{i}"), F.col("position").alias(f"_at_{i}"))
        rows = rows.join(known, F.col(f"_value_{i}") == F.col(f"_known_{i}"), "left")
        slots.append(F.col(f"_at_{i}") + begin)
        begin += max(1, counts.get(c, 0))
    width = begin

    @F.udf(VectorUDT())
    def sparse(dense: list[float], slots: list[int]) -> SparseVector:
        at = [i for i, v in enumerate(dense) if v] + slots
        return SparseVector(width, at, [dense[i] if i < n_dense else 1.0 for i in at])

    return rows.select(*[col(c) for c in held if c != out], sparse("_dense", F.array_compact(F.array(*slots))).alias(out))


def onehot_vector(df: DataFrame, columns: Sequence[str], vocabulary: DataFrame, out: str = "features") -> DataFrame:
    """Adds one sparse vector of all columns, in their order."""
    return with_vector(df, vocabulary, {c: col(c).cast("string") for c in columns}, sizes(vocabulary), out)


def slot_sums(df: DataFrame, vector: str = "features") -> DataFrame:
    """(slot, sum) over all rows, for the slots some row sets; vectors stay sparse, so their width costs nothing."""
    held = F.unwrap_udt(col(vector))
    slots = F.coalesce(held["indices"], F.transform(held["values"], lambda _v, i: i))
    cells = df.select(F.explode(F.arrays_zip(slots.alias("slot"), held["values"].alias("value"))).alias("c"))
    return cells.groupBy(F.col("c.slot").cast("long").alias("slot")).agg(F.sum("c.value").alias("sum"))
