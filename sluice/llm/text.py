"""Cutting texts at white space, and bounded per-worker tables of what distinct pieces give."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Unicode White_Space: what the tokenizers' patterns call \s. (Python's own \s also takes 1C to 1F.)
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_led = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_word = re.compile(f"[^{SPACE}]+")
_no_space = re.compile("[\x1c-\x1f]")
_edge = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")

#: Characters that are cut into pieces at once; longer texts go in parts.
PART = 1 << 20


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, each but the first starting with the white space after a word.

    A run without such an edge stays whole, however long it is.
    """
    at = 0
    while len(text) - at > size:
        edge = _edge.search(text, at + size)
        if edge is None:
            break
        yield text[at:edge.start()]
        at = edge.start()
    yield text[at:] if at else text


def led_words(text: str) -> list[str]:
    """Words with the white space before them; what trails is a piece of its own. Joined they give ``text``."""
    return _led.findall(text)


def bare_words(text: str) -> list[str]:
    return _word.findall(text) if _no_space.search(text) else text.split()


class PieceTable:
    """What distinct pieces give, worked out once and kept up to a bound of pieces and of their length.

    A worker keeps its table over batches and tasks. Emptying it costs time, never results.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], limit: int = 300_000, longest: int = 64,
                 batch_bytes: int = 1 << 20):
        self.compute, self.limit, self.longest, self.batch_bytes = compute, limit, longest, batch_bytes
        self.known: dict = {}

    def learn(self, lists: list[list[str]]) -> dict:
        """A table that has every piece of ``lists``."""
        new = set(chain.from_iterable(lists)).difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = set(chain.from_iterable(lists))
        table, brief = self.known, [p for p in new if len(p) <= self.longest]
        for some in even_batches(brief, self.batch_bytes):
            table.update(zip(some, self.compute(some)))
        if len(brief) < len(new):
            table = dict(table)
            for some in even_batches([p for p in new if len(p) > self.longest], self.batch_bytes):
                table.update(zip(some, self.compute(some)))
        return table


def even_batches(pieces: list[str], most: int) -> Iterator[list[str]]:
    """``pieces`` by length, in batches of up to ``most`` characters (or one longer piece)."""
    some, held = [], 0
    for p in sorted(pieces, key=len):
        if some and held + len(p) > most:
            yield some
            some, held = [], 0
        some.append(p)
        held += len(p)
    if some:
        yield some


def groups(texts: list[str], most: int = PART) -> Iterator[list[str]]:
    """Neighbouring texts, up to ``most`` characters together or one longer text."""
    some, held = [], 0
    for t in texts:
        if some and held + len(t) > most:
            yield some
            some, held = [], 0
        some.append(t)
        held += len(t)
    if some:
        yield some


def text_column(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def first_by_hash(df: DataFrame, rows: int, limit: int, *columns: str) -> DataFrame:
    """The first ``limit`` of ``rows`` rows of ``df`` in the order of a hash of ``columns``.

    Only rows whose hash is low enough for about four times as many are sorted, so that what the tasks hand over
    does not grow with their number.
    """
    low, whole = F.pmod(F.xxhash64(*columns), F.lit(1 << 30)), 1 << 30
    return df.where(low < int(min(1.0, 4 * limit / max(rows, 1)) * whole)).orderBy(low, *columns).limit(limit)


#: Rows of an Arrow batch: Spark has no bound in bytes, so a batch of long texts must hold few of them.
BATCH_ROWS = 512


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
