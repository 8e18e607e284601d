"""Vectors as bytes, for grouping, joining and fast stacking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sluice.llm.text import short_batches


def width_of(df: DataFrame, column: str) -> str:
    """The element type that keeps the column's values: 4-byte or 8-byte floats."""
    element = getattr(df.schema[column].dataType, "elementType", None)
    return "<f4" if isinstance(element, T.FloatType) else "<f8"


def packed(df: DataFrame, column: str) -> Column:
    """The vector's bytes; null if it is null, empty, zero, or holds null or non-finite components."""
    kind = width_of(df, column)
    short_batches(df.sparkSession, 4096)

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series([_bytes(v, kind) for v in vectors], dtype=object)

    return pack(df[column].cast("array<float>" if kind == "<f4" else "array<double>"))


def _bytes(vector, kind: str) -> bytes | None:
    if vector is None:
        return None
    values = np.array(vector, kind) + 0.0  # no negative zeros: equal vectors have equal bytes
    return values.tobytes() if len(values) and np.isfinite(values).all() and values.any() else None


def stacked(column: pd.Series, kind: str) -> np.ndarray:
    """Rows of doubles of packed vectors, all as long as the first."""
    if not len(column):
        return np.zeros((0, 0))
    flat = np.frombuffer(b"".join(column), kind)
    return flat.reshape(len(column), -1).astype(np.float64)


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaled first, so that very large or small components do no harm."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / lengths(rows)[:, None]
