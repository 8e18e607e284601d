"""Duplicate removal within and across splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sluice.operators import labels
from sluice.schemas import TARGET


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; NaN equals NaN and null equals null."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows, and rows that repeat another row. Equal rows are counted before the shuffle."""
    per_row = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return per_row.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
                       F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))


def keep_first(df: DataFrame, features: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per feature tuple the earliest row by ``order``, then by its other columns.

    The earliest row is a minimum, so copies of a tuple shrink to one row per task
    before the shuffle and a tuple with very many copies is no burden.
    """
    rest = [c for c in df.columns if c not in set(features) | set(order)]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    kept = df.groupBy(*features).agg(first)
    return kept.select(*[F.col(c) if c in features else F.col("_first")[c].alias(c) for c in df.columns])


def combine_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    """Training rows, then test rows with training label names; ``split_rank`` keeps the order."""
    test = labels.rename_or_keep(labels.drop_test_only(train, test)).where(F.col(TARGET).isNotNull())
    return (train.withColumn("split_rank", F.lit(0))
            .unionByName(test.withColumn("split_rank", F.lit(1)), allowMissingColumns=True))


def _feature_tuple(types: Mapping[str, str], alias: str) -> tuple[Column, Column]:
    refs = [F.col(f"{alias}.`{c}`").cast(kind) for c, kind in types.items()]
    return F.xxhash64(*refs), F.struct(*refs)


def common_features(train: DataFrame, test: DataFrame, label: str = TARGET) -> list[str]:
    return [c for c in train.columns if c in test.columns and c != label]


def _seen_join(train: DataFrame, test: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Joins test rows with the distinct training tuples, null matching null.

    The hash leads the join key so that sorting compares one number; the tuple itself
    is compared as well, so equal hashes of different rows do no harm. Distinct tuples
    on the right leave only the test side to be hot, which AQE splits.
    """
    types = _common_types(train, test, columns)
    seen = train.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in columns]).distinct().alias("a")
    ha, ta = _feature_tuple(types, "a")
    hb, tb = _feature_tuple(types, "b")
    return test.alias("b").join(seen, (ha == hb) & ta.eqNullSafe(tb), how)


def _common_types(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The type each column has in a union of both sides; equal values of different types hash alike only in it."""
    both = train.select(*[F.col(f"`{c}`") for c in columns]).limit(0).union(test.select(*[F.col(f"`{c}`") for c in columns]).limit(0))
    return {c: f.dataType.simpleString() for c, f in zip(columns, both.schema.fields)}


def remove_seen_in_training(train: DataFrame, test: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Test rows whose features do not occur in training, whatever their label."""
    columns = common_features(train, test) if columns is None else columns
    return _seen_join(train, test, columns, "left_anti") if columns else test


def seen_in_training(train: DataFrame, test: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = common_features(train, test) if columns is None else columns
    return _seen_join(train, test, columns, "left_semi") if columns else test.limit(0)


def tag_sources(**frames: DataFrame) -> DataFrame:
    """Union of frames by column name with the name of each in ``_source``."""
    tagged = [df.withColumn("_source", F.lit(name)) for name, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
