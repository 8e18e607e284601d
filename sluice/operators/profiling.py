"""Data summaries and class balance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sluice.functions.columns import ColumnFacts, column_facts
from sluice.functions.scalars import col, numeric_columns
from sluice.operators import dedup
from sluice.schemas import TARGET


def label_distribution(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows and share per label, largest first. Totals are taken over the few label rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percent", F.col("count") / total * 100.0).orderBy(F.desc("count"), label)


def dtype_counts(df: DataFrame) -> DataFrame:
    """Columns and non-null cells per type, in one pass."""
    kinds = [F.struct(F.lit(t).alias("dtype"), F.count(col(c)).alias("cells")) for c, t in df.dtypes]
    cells = df.agg(F.array(*kinds).alias("k")).select(F.inline("k"))
    return cells.groupBy("dtype").agg(F.count(F.lit(1)).alias("columns"), F.sum("cells").alias("cells"))


def low_cardinality(df: DataFrame, columns: Sequence[str], below: int) -> dict[str, int]:
    """Distinct non-null values of the columns that have fewer than ``below``. NaN is missing, infinities are values."""
    facts = column_facts(df, columns, limit=below)
    return {c: f.distinct for c, f in facts.items() if f.distinct < below}


def column_classes(df: DataFrame, below: int = 10) -> tuple[list[str], list[str]]:
    """(categorical, numerical): numbers with fewer than ``below`` distinct values count as categories."""
    return _classes(df, column_facts(df, numeric_columns(df), limit=below), below)


def _classes(df: DataFrame, facts: Mapping[str, ColumnFacts], below: int) -> tuple[list[str], list[str]]:
    numeric = numeric_columns(df)
    few = [c for c in numeric if facts[c].distinct < below]
    return [c for c in df.columns if c not in numeric] + few, [c for c in numeric if c not in few]


def missing_and_infinite(df: DataFrame) -> DataFrame:
    """Missing and infinite cells over all columns, in one pass."""
    facts = column_facts(df).values()
    cells = max((f.rows for f in facts), default=0), sum(f.missing for f in facts), sum(f.infinite for f in facts)
    return df.sparkSession.createDataFrame([cells], "rows long, missing long, infinite long")


def summary(below: int = 10, **splits: DataFrame) -> DataFrame:
    """The data report in long form: (split, metric, item, value).

    One pass tells the facts of all columns; repeated rows and labels are counted by an aggregate each.
    """
    out = None
    for split, df in splits.items():
        facts = column_facts(df, limit=below)
        categorical, numerical = _classes(df, facts, below)
        plain = [("rows", max((f.rows for f in facts.values()), default=0)), ("missing", sum(f.missing for f in facts.values())),
                 ("infinite", sum(f.infinite for f in facts.values())), ("columns", len(df.columns)),
                 ("categorical_columns", len(categorical)), ("numerical_columns", len(numerical))]
        types = sorted(Counter(t for _, t in df.dtypes).items())
        known = [(m, "", float(v)) for m, v in plain] + [("dtype_columns", t, float(n)) for t, n in types]
        part = df.sparkSession.createDataFrame(known, "metric string, item string, value double")
        dup = dedup.duplicate_count(df).selectExpr("'duplicates' as metric", "'' as item", "cast(duplicates as double) as value")
        dist = label_distribution(df)
        dist = dist.selectExpr("stack(2, 'label_rows', cast(count as double), 'label_percent', percent) as (metric, value)",
                               f"{TARGET} as item").select("metric", "item", "value")
        part = part.unionByName(dup).unionByName(dist).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def class_distribution(df: DataFrame, classes: Sequence[str], split: str, label: str = TARGET) -> DataFrame:
    """Rows and share of every class, classes without rows included."""
    dim = df.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    joined = dim.join(counts, "class", "left").withColumn("count", F.coalesce("n", F.lit(0)))
    total = F.greatest(F.sum("count").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return joined.select(F.lit(split).alias("split"), "class", "count",
                         (F.col("count") / total * 100.0).alias("percent"))


def imbalance(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Largest over smallest class, and whether that or the smallest share calls for balancing."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.sum("n").alias("total"))
    ratio = F.col("hi") / F.col("lo")
    return stats.select(ratio.alias("imbalance_ratio"),
                        ((ratio >= 3.0) | (F.col("lo") / F.col("total") < 0.05)).alias("is_imbalanced"))


def balanced_weights(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Weight of each class: all rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(1))
    return counts.select(label, "n", (F.sum("n").over(everything) /
                                      (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight"))


def with_balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds the class weight to each row; the weights of a class vocabulary are literals."""
    pairs = {r[label]: r["weight"] for r in balanced_weights(df, label).collect()}
    weight = F.lit(None).cast("double")
    for value, w in pairs.items():
        weight = F.when(F.col(label) == value, F.lit(w)).otherwise(weight)
    return df.withColumn(out, weight)
