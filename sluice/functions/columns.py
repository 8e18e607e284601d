"""Statistics of many columns in one pass each, without an expression per column.

Tasks read Arrow batches of the columns and return short rows (column number, value, count) that one aggregate puts
together, so the plan has the same size for one column and for hundreds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sluice.functions.scalars import col, numeric_columns

# A task hands on what it has counted once it holds this many (column, value) entries.
PENDING = 1 << 20


@dataclass(frozen=True)
class ColumnFacts:
    """What one pass tells of a column. NaN is missing, infinities are values; ``finite_*`` leave them out."""

    rows: int
    missing: int
    infinite: int
    distinct: int  # non-null values; exact up to the limit asked for, and one above it for all that have more
    finite_lo: float | None
    finite_hi: float | None

    @property
    def is_constant(self) -> bool:
        """At most one value, null counting as one."""
        return self.distinct == 0 or (self.distinct == 1 and self.missing == 0)


def _readable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns under numbers as names; nested ones as text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)

    kinds = {f.name: f.dataType for f in df.schema.fields}

    def value(c: str) -> Column:
        if isinstance(kinds[c], nested):
            return F.when(col(c).isNotNull(), F.to_json(F.struct(col(c))))
        return col(c) if isinstance(kinds[c], flat) else col(c).cast("string")

    return df.select(*[value(c).alias(str(i)) for i, c in enumerate(columns)])


def _name(value: object) -> str:
    """A value as short text; long ones by their digest."""
    raw = value if isinstance(value, bytes) else str(value).encode()
    return raw.decode() if len(raw) <= 32 and not isinstance(value, bytes) else hashlib.md5(raw).hexdigest()


class _Tally:
    """Running facts of one column in one task."""

    def __init__(self, numeric: bool, limit: int):
        self.numeric, self.limit = numeric, limit
        self.missing = self.infinite = 0
        self.lo, self.hi = np.inf, -np.inf
        self.seen: set[str] = set()

    def add(self, values: pa.Array) -> None:
        self.missing += values.null_count
        if values.null_count:
            values = values.drop_null()
        if self.numeric:
            x = pc.cast(values, pa.float64(), safe=False).to_numpy(zero_copy_only=False)
            if pa.types.is_floating(values.type):
                number = ~np.isnan(x)
                self.missing += int(len(x) - number.sum())
                x = x[number] + 0.0  # -0.0 is 0.0
                values = pa.array(x)
                finite = x[np.isfinite(x)]
                self.infinite += len(x) - len(finite)
                x = finite
            if len(x):
                self.lo, self.hi = min(self.lo, x.min()), max(self.hi, x.max())
        if len(self.seen) <= self.limit and len(values):
            different = pc.unique(values)
            # One value more than the limit tells that there are too many.
            self.seen |= {_name(v) for v in different[:len(self.seen) + self.limit + 1].to_pylist()}


def column_facts(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 1) -> dict[str, ColumnFacts]:
    """Facts of each column in one pass. Distinct values are exact up to ``limit``.

    A task returns at most three times ``limit`` + 1 values a column, so counting them is small work whatever the column holds.
    An empty frame has facts too: no rows and no values.
    """
    columns = list(df.columns if columns is None else columns)
    if not columns:
        return {}
    numbers = set(numeric_columns(df))
    numeric = [c in numbers for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies, rows = [_Tally(n, limit) for n in numeric], 0
        for batch in batches:
            rows += batch.num_rows
            for tally, values in zip(tallies, batch.columns):
                tally.add(values)
        out = []
        for i, t in enumerate(tallies):
            bounds = (None, None) if t.lo > t.hi else (float(t.lo), float(t.hi))
            out.append((i, None, rows, t.missing, t.infinite, *bounds))
            out += [(i, v, 0, 0, 0, None, None) for v in t.seen]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    schema = pa.schema([("i", pa.int32()), ("v", pa.string()), ("rows", pa.int64()), ("missing", pa.int64()),
                        ("infinite", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())])
    parts = _readable(df, columns).mapInArrow(run, "i int, v string, rows long, missing long, infinite long, lo double, hi double")
    values = parts.groupBy("i", "v").agg(*[F.sum(n).alias(n) for n in ("rows", "missing", "infinite")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = values.groupBy("i").agg(*[F.sum(n).alias(n) for n in ("rows", "missing", "infinite")], F.count("v").alias("distinct"),
                                    F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = {r["i"]: r for r in whole.collect()}
    facts = {}
    for i, c in enumerate(columns):
        r = found.get(i)
        facts[c] = (ColumnFacts(0, 0, 0, 0, None, None) if r is None else
                    ColumnFacts(r["rows"], r["missing"], r["infinite"], min(r["distinct"], limit + 1), r["lo"], r["hi"]))
    return facts


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers in the same order; 0.0 and -0.0 are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_ordered_bits(bits: int) -> float:
    return float(np.array([bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF], np.int64).view(np.float64)[0])


@dataclass
class _Middle:
    """The two middle ranks of a column, and the leading bits known of their values."""

    ranks: tuple[int, int]
    below: int
    inside: int
    prefixes: tuple[int, ...]


def exact_medians(df: DataFrame, columns: Sequence[str], middle_values: int = 250_000) -> dict[str, float | None]:
    """Median per column over finite values, the mean of the middle two; None if there are none.

    Values are counted by their leading 16 bits; the two middle ranks fall in one or two of these bins, whose values are
    counted by the next bits, and by all bits as soon as a column has no more than ``middle_values`` rows there. Four
    passes give exact medians of any column, two are enough for most.
    """
    columns = list(columns)
    if not columns:
        return {}
    values = df.select(*[col(c).cast("double").alias(str(i)) for i, c in enumerate(columns)])
    shift, open_, out = 48, {i: None for i in range(len(columns))}, dict.fromkeys(columns)
    last = None
    while open_:
        found = _middle_bins(values.select(*[str(i) for i in open_]), open_, shift, last)
        for i in list(open_):
            if i not in found:
                del open_[i]
            elif shift == 0:
                lo, hi = found[i].prefixes[0], found[i].prefixes[-1]
                out[columns[i]] = (from_ordered_bits(lo) + from_ordered_bits(hi)) / 2
                del open_[i]
            else:
                open_[i] = found[i]
        last = shift
        shift = 0 if all(m.inside <= middle_values for m in open_.values()) else shift - 16
    return out


def _middle_bins(values: DataFrame, open_: dict[int, _Middle | None], shift: int, last: int | None) -> dict[int, _Middle]:
    """The bins, by the bits from ``shift`` on, in which the middle ranks of the open columns fall."""
    numbers = list(open_)
    known = [None if m is None else np.array(m.prefixes, np.int64) for m in open_.values()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            for i, prefixes, column in zip(numbers, known, batch.columns):
                x = (column.drop_null() if column.null_count else column).to_numpy(zero_copy_only=False)
                bits = ordered_bits(x[np.isfinite(x)])
                if prefixes is not None:
                    lead = bits >> last
                    bits = bits[(lead == prefixes[0]) | (lead == prefixes[-1])]
                counts.add(i, *np.unique(bits >> shift, return_counts=True))
            yield from counts.pass_on()
        yield from counts.everything()

    bins = values.mapInArrow(run, "i int, b long, n long").groupBy("i", "b").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("i").orderBy("b")
    ranked = bins.select("i", "b", "n", F.sum("n").over(upto).alias("end"), F.sum("n").over(Window.partitionBy("i")).alias("total"))
    if last is None:
        lower, upper, end = F.expr("(total - 1) div 2"), F.expr("total div 2"), F.col("end")
    else:
        ranks = values.sparkSession.createDataFrame([(i, *m.ranks, m.below) for i, m in open_.items()], "i int, lower long, upper long, below long")
        ranked = ranked.join(ranks, "i")
        lower, upper, end = F.col("lower"), F.col("upper"), F.col("end") + F.col("below")
    hit = lambda r: ((end - F.col("n")) <= r) & (r < end)
    rows = ranked.where(hit(lower) | hit(upper)).select("i", "b", "n", end.alias("end"), lower.alias("lower"), upper.alias("upper")).collect()
    found: dict[int, _Middle] = {}
    for r in sorted(rows, key=lambda r: (r["i"], r["b"])):
        m = found.setdefault(r["i"], _Middle((r["lower"], r["upper"]), r["end"] - r["n"], 0, ()))
        m.inside, m.prefixes = m.inside + r["n"], (*m.prefixes, r["b"])
    return found


class _Counts:
    """(column, value, count) entries of a task, put together before they are handed on."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.pending = 0

    def add(self, i: int, values: np.ndarray, counts: np.ndarray) -> None:
        if len(values):
            self.parts.setdefault(i, []).append((values, counts))
            self.pending += len(values)

    def _merge(self) -> None:
        self.pending = 0
        for i, parts in self.parts.items():
            values, back = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            total = np.zeros(len(values), np.int64)
            np.add.at(total, back, np.concatenate([n for _, n in parts]))
            self.parts[i] = [(values, total)]
            self.pending += len(values)

    def pass_on(self) -> Iterator[pa.RecordBatch]:
        if self.pending > PENDING:
            self._merge()
            if self.pending > PENDING // 2:
                yield from self.everything()

    def everything(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        for i, [(values, counts)] in self.parts.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), pa.array(values), pa.array(counts)], ["i", "b", "n"])
        self.parts, self.pending = {}, 0
