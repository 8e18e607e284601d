"""Feature selection fitted on the training split."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.columns import column_facts
from sluice.functions.scalars import col, finite
from sluice.operators import cleaning

# Column names that give the answer away, matched on the normalised name.
LEAKAGE_PATTERNS = [
    r"^label$", r"target", r"attack", r"class", r"category", r"flow\s*id", r"session",
    r"timestamp", r"time\s*stamp", r"src\s*ip", r"source\s*ip", r"dst\s*ip", r"destination\s*ip",
    r"src\s*port", r"source\s*port", r"dst\s*port", r"destination\s*port", r"sport", r"dport",
    r"source[_\s-]*file", r"filename", r"file[_\s-]*name", r"__source",
]
# Column names that can group rows for cross-validation.
GROUP_PATTERNS = [
    r"flow\s*id", r"session", r"src\s*ip", r"source\s*ip", r"dst\s*ip", r"destination\s*ip",
    r"src\s*port", r"source\s*port", r"dst\s*port", r"destination\s*port",
    r"source[_\s-]*file", r"filename", r"file[_\s-]*name",
]


def _matches(name: str, patterns: Iterable[str]) -> bool:
    plain = re.sub(r"[_\-]+", " ", name.strip().lower())
    return any(re.search(p, plain) for p in patterns)


def leakage_columns(columns: Iterable[str], patterns: Iterable[str] = LEAKAGE_PATTERNS) -> list[str]:
    return [c for c in columns if _matches(c, patterns)]


def group_column(df: DataFrame) -> str | None:
    """First column fit to group rows that has more than one value."""
    names = [c for c in df.columns if _matches(c, GROUP_PATTERNS)]
    texts = [F.coalesce(col(c).cast("string"), F.lit("nan")) for c in names]
    row = df.agg(*[a for t in texts for a in (F.min(t), F.max(t))]).first() if names else ()
    return next((c for k, c in enumerate(names) if row[2 * k] != row[2 * k + 1]), None)


def single_value_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with exactly one non-null value; a column of nulls only is kept."""
    return [c for c, f in column_facts(df, columns).items() if f.distinct == 1]


def constant_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at most one value, null counting as a value."""
    return [c for c, f in column_facts(df, columns).items() if f.is_constant]


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Absolute Pearson correlation of complete columns; NaN where a column is constant.

    Sums are combined on the executors in a tree; only the matrix reaches the driver.
    """
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(
        df.select(*[col(c).cast("double").alias(c) for c in columns])).select("_v")
    return np.abs(Correlation.corr(vectors, "_v").head()[0].toArray())


def pairwise_correlations(df: DataFrame, columns: Sequence[str], chunk: int = 150) -> np.ndarray:
    """Absolute Pearson correlation over the rows where both columns are valid."""
    x = {c: finite(col(c).cast("double")) for c in columns}
    pairs = [(i, j) for j in range(len(columns)) for i in range(j)]
    out = np.full((len(columns), len(columns)), np.nan)
    np.fill_diagonal(out, 1.0)
    for start in range(0, len(pairs), chunk):
        part = pairs[start:start + chunk]
        row = df.agg(*[pair_correlation(x[columns[i]], x[columns[j]]).alias(f"r{k}")
                       for k, (i, j) in enumerate(part)]).first()
        for (i, j), r in zip(part, row):
            out[i, j] = out[j, i] = np.nan if r is None else abs(r)
    return out


def pair_correlation(a: Column, b: Column) -> Column:
    """corr(a, b) that is null instead of an error when a side does not vary."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def highly_correlated(columns: Sequence[str], corr: np.ndarray, threshold: float) -> list[str]:
    """Columns correlated above the threshold with any earlier column, dropped ones included."""
    return [c for j, c in enumerate(columns) if any(corr[i, j] > threshold for i in range(j))]


def correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Columns to drop for correlation, after filling gaps with medians."""
    if len(columns) < 2:
        return []
    medians = cleaning.fit_medians(df, columns)
    filled = cleaning.apply_medians(df.select(*[col(c) for c in columns]), medians)
    return highly_correlated(columns, correlation_matrix(filled, columns), threshold)


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drops a fitted list; columns the frame lacks are ignored."""
    return df.drop(*columns)


def dropped_report(spark, dropped: dict[str, list[str]]) -> DataFrame:
    rows = [(reason, c) for reason, cols in dropped.items() for c in cols]
    return spark.createDataFrame(rows, "reason string, column string")
