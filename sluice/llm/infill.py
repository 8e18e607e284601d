"""Fill-in-middle forms of texts: places by code point found with word-parallel arithmetic on UTF-8.

A batch of texts is one run of bytes, viewed as 64-bit words. A byte ends a code point if the byte after it is no
continuation byte (10xxxxxx). All eight bytes of a word are marked at once, ``bitwise_count`` counts the marks of each
word, a search in the running counts finds the word that holds the k-th end, and halving inside the word finds the byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.text import short_batches, text_column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_HIGH = np.uint64(0x8080808080808080)


class Ends:
    """Ends of the code points in a run of valid UTF-8."""

    def __init__(self, data: np.ndarray):
        room = np.full(len(data) // 8 * 8 + 8, 0x80, np.uint8)  # continuation bytes end nothing
        room[:len(data)] = data
        room[len(data)] = 0  # starts anew, so that the last byte of the run ends its code point
        words = room.view("<u8")
        starts = ~(words & ~(words << np.uint64(1))) & _HIGH  # no 10xxxxxx, marked in the high bit of the byte
        after = np.append(starts[1:], np.uint64(0)) << np.uint64(56)
        self.marks = (starts >> np.uint64(8)) | after
        self.upto = np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that end before byte ``at``."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (np.uint64(8) * byte)) - np.uint64(1)
        inside = np.bitwise_count(self.marks[word] & below).astype(np.int64)
        return np.where(word > 0, self.upto[np.maximum(word - 1, 0)], 0) + inside

    def place(self, k: np.ndarray) -> np.ndarray:
        """The byte after the end of the k-th code point, counted from 1; 0 for the 0th."""
        word = np.minimum(np.searchsorted(self.upto, k), len(self.marks) - 1)
        left = k - np.where(word > 0, self.upto[np.maximum(word - 1, 0)], 0)
        bits, byte = self.marks[word], np.zeros(len(k), np.int64)
        for step in (4, 2, 1):
            low = bits & ((np.uint64(1) << np.uint64(8 * step)) - np.uint64(1))
            held = np.bitwise_count(low).astype(np.int64)
            beyond = held < left
            bits = np.where(beyond, bits >> np.uint64(8 * step), low)
            left, byte = np.where(beyond, left - held, left), byte + step * beyond
        return np.where(k > 0, 8 * word + byte + 1, 0)


def _cut_batch(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each text its number of code points, and those of prefix and middle with their byte places."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    run = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    ends = Ends(run)
    before = ends.rank(bounds)
    n = np.diff(before)
    one, two = first % (n + 1), second % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    at = [np.where(k > 0, ends.place(before[:-1] + k), bounds[:-1]) for k in (low, high)]
    return n, low, high - low, run, bounds, *at


def _forms(texts: pa.Array, h: list[np.ndarray], plain: np.ndarray, spm_share: int) -> pa.StructArray:
    n, prefix, middle, run, bounds, one, two = _cut_batch(texts, h[0], h[1])
    raw = run.tobytes()
    plain = plain | (n == 0)
    spm = ~plain & (h[3] % 100 < spm_share)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for a, b, i, j, is_plain, is_spm in zip(bounds, bounds[1:], one, two, plain, spm):
        if is_plain:
            out.append(raw[a:b])
        elif is_spm:
            out.append(b"".join((s, raw[j:b], p, raw[a:i], m, raw[i:j])))
        else:
            out.append(b"".join((p, raw[a:i], s, raw[j:b], m, raw[i:j])))
    return pa.StructArray.from_arrays(
        [pa.array(n), pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string()), pa.array(prefix, mask=plain),
         pa.array(middle, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
        ["n", "form", "prefix_chars", "middle_chars", "output"])


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four whole numbers below 2^32 from the hex sha256 of the seed, a colon and ``key`` as text (null: nothing)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, share: int = 90, spm_share: int = 20, text: str = "text", key: str = "doc_id",
                   seed: str = "1") -> DataFrame:
    """``docs`` with n (code points), form, prefix_chars, middle_chars and output of column ``text``.

    Draws from the ``key`` cut the code points in prefix, middle and suffix. Of 100 texts, ``share`` are turned, of
    these ``spm_share`` to the form spm (suffix first), others to psm; the rest, empty texts (null ones too) and those
    that hold one of the marks stay plain, with null lengths. Texts are cut whole, however long; equal keys draw
    alike, and a null key draws as an empty one. An empty table gives none. Columns of ``docs`` named like the new
    ones are replaced. One pass without shuffle; a lost task is run again with the same draws.
    """
    short_batches(docs.sparkSession)

    @F.arrow_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def formed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, keep, *h in batches:
            texts = texts.cast(pa.string())
            yield _forms(texts, [x.to_numpy(zero_copy_only=False) for x in h], keep.to_numpy(zero_copy_only=False), spm_share)

    body, h = text_column(docs, text), draws(docs[key], seed)
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    held = max(docs.columns, key=len) + "_made"
    made = docs.withColumn(held, formed(body, marked | (h[2] % 100 >= share), *h))
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    return made.withColumns({c: F.col(f"`{held}`.{c}") for c in names}).drop(held)


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` turned, from its output and form. Marks occur once each, as texts hold none."""
    def between(left: str, right: str | None) -> Column:
        rest = F.split_part(output, F.lit(left), F.lit(2))
        return rest if right is None else F.split_part(rest, F.lit(right), F.lit(1))

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def oracle_sql(share: int = 90, spm_share: int = 20, seed: str = "1") -> str:
    """DuckDB's way to n, form, lengths and digests. Its restored text is the text itself."""
    draw = [f"('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), {1 + 8 * i}, 8))::bigint as h{i + 1}" for i in range(4)]
    return f"""
    with t as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, {', '.join(draw)} from documents),
    f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as one, greatest(h1 % (n + 1), h2 % (n + 1)) as two, case
        when n = 0 or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {share} then 'plain'
        when h4 % 100 < {spm_share} then 'spm' else 'psm' end as form from t),
    c as (select *, substr(text, 1, one) as pre, substr(text, one + 1, two - one) as mid, substr(text, two + 1) as suf from f)
    select doc_id, n::bigint as n, form, case when form <> 'plain' then one end::bigint as prefix_chars,
        case when form <> 'plain' then two - one end::bigint as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
            else '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid end) as output_sha256,
        sha256(text) as restored_sha256 from c"""
