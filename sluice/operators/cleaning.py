"""Invalid values and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.columns import exact_medians
from sluice.functions.scalars import col, finite, floating_columns, is_infinite, numeric_columns, to_finite
from sluice.schemas import EXTRACTOR_COLUMNS, FEATURES, TARGET, TIME_FEATURES


def _all_columns(df: DataFrame, changed: Mapping[str, Column]) -> DataFrame:
    """One projection over all columns (chained withColumn would nest)."""
    return df.select(*[changed[c].alias(c) if c in changed else col(c) for c in df.columns])


def invalid_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities of floating columns become null."""
    floats = floating_columns(df)
    return _all_columns(df, {c: finite(col(c)) for c in (columns or df.columns) if c in floats})


def count_infinite(df: DataFrame) -> DataFrame:
    floats = sorted(floating_columns(df))
    total = F.lit(0)
    for c in floats:
        total = total + F.coalesce(is_infinite(col(c)).cast("int"), F.lit(0))
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("infinite"))


def fit_medians(train: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float]:
    """Medians of the training split; 0 for a column without valid values."""
    columns = numeric_columns(train, [TARGET]) if columns is None else columns
    return {c: 0.0 if m is None else m for c, m in exact_medians(train, columns).items()}


def apply_medians(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    """Fills invalid and missing values with training medians."""
    floats = floating_columns(df)
    return _all_columns(df, {c: F.coalesce(finite(col(c)) if c in floats else col(c).cast("double"), F.lit(float(m)))
                             for c, m in medians.items() if c in df.columns})


def impute_with_own_medians(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fills with the frame's own medians; a column without valid values stays null."""
    columns = numeric_columns(df, [TARGET]) if columns is None else columns
    medians = {c: m for c, m in exact_medians(df, columns).items() if m is not None}
    return invalid_to_null(apply_medians(df, medians), columns)


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent non-null value per column, the smallest among equals.

    Values are counted across the cluster; only the winner of each column is returned.
    """
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in columns])
    counts = (df.select(F.explode(pairs).alias("p")).where(F.col("p.v").isNotNull())
              .groupBy("p.c", "p.v").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("r"), "v")).alias("b")).select("c", "b.v")
    return {r["c"]: r["v"] for r in best.collect()}


def impute_most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = most_frequent(df, columns)
    return _all_columns(df, {c: F.coalesce(col(c).cast("string"), F.lit(m)) for c, m in modes.items()})


# ---- extractor rows to the model schema ----


def strip_and_rename(df: DataFrame) -> DataFrame:
    """Drops the label, trims header names and gives extractor columns their model names."""
    df = df.drop(TARGET)
    stripped = df.toDF(*[c.strip() for c in df.columns])
    return stripped.withColumnsRenamed(EXTRACTOR_COLUMNS)


def conform(df: DataFrame) -> DataFrame:
    """Exactly the model features in order; absent ones are 0."""
    return df.select(*[col(c).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in FEATURES])


def normalise_flow_rows(df: DataFrame, input_unit: str = "s") -> DataFrame:
    """Extractor rows as model features, with the raw columns kept beside them as struct ``raw``.

    Values are converted before infinities are removed, so text such as ``inf`` becomes null too.
    """
    stripped = df.toDF(*[c.strip() for c in df.columns])
    source = {EXTRACTOR_COLUMNS.get(c, c): c for c in stripped.columns if c != TARGET}

    def feature(name: str) -> Column:
        if name not in source:
            return F.lit(0.0)
        value = to_finite(col(source[name]))
        return value * 1e6 if input_unit == "s" and name in TIME_FEATURES else value

    raw = F.struct(*[col(c) for c in stripped.columns if c != TARGET]).alias("raw")
    return stripped.select(raw, *[feature(f).alias(f) for f in FEATURES])


def batch_stats(features: DataFrame) -> DataFrame:
    """Rows, SYN flags and mean duration of a scored batch."""
    return features.agg(F.count(F.lit(1)).alias("rows"),
                        F.coalesce(F.sum(col("SYN Flag Count")), F.lit(0.0)).alias("syn_flags_total"),
                        F.avg(col("Flow Duration")).alias("flow_duration_mean_us"))
