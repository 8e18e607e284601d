"""Quality scores: histogram gradient-boosted trees over document statistics, held as flat arrays."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.text import PART, parts, short_batches, text_column

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SENTENCE_MARKS = np.frombuffer(b".,;:!?", np.uint8)
_OTHER_MARKS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)

STATISTICS = [
    "bytes", "words", "lines", "upper", "digits", "not_ascii", "sentence_marks", "other_marks", "bangs", "blank",
    "byte_entropy", "word_length", "word_length_spread", "longest_word", "short_words", "distinct_words",
    "commonest_word", "words_once", "repeated_pairs", "repeated_lines", "words_a_line", "words_with_mark",
    "words_all_upper", "words_with_digit", "words_repeated_at_once", "words_a_sentence", "links", "capitals",
]


def statistics(text: str) -> list[float]:
    """The values of ``STATISTICS`` of one whole text; an empty text has finite ones too.

    A long text is counted in parts and the counts are put together, words, pairs of words and lines by hash, so that
    its words are never held together; what is measured does not depend on the length.
    """
    if len(text) <= PART:
        return _measured([_tally(text)], *_lines([text]))
    tallies, last = [], None
    for part in parts(text):
        tallies.append(_tally(part, last).hashed())
        last = tallies[-1].last or last
    return _measured(tallies, *_lines(_pieces(text)))


@dataclass
class Tally:
    """Counts of a part of a text. ``seen`` counts its words; ``pairs`` are neighbours, the word before the part too."""

    data: np.ndarray  # how often each byte occurs
    words: int
    letters: list[int]  # sum, sum of squares and largest of the lengths of words
    short: int
    seen: Counter
    pairs: set
    repeated: int
    links: int
    last: str | None

    def hashed(self) -> Tally:
        """The same with whole words and pairs replaced by arrays of hashes; kinds of words are counted before."""
        self.kinds = self.kind_counts()
        self.seen = (np.fromiter(map(hash, self.seen), np.int64, len(self.seen)), np.fromiter(self.seen.values(), np.int64, len(self.seen)))
        self.pairs = np.fromiter(map(hash, self.pairs), np.int64, len(self.pairs))
        return self

    def kind_counts(self) -> list[int]:
        """Words that end in a mark, that are upper case, that hold a digit, that begin upper case."""
        seen = self.seen
        return [sum(c for w, c in seen.items() if not w[-1].isalnum()), sum(c for w, c in seen.items() if w.isupper() and len(w) > 1),
                sum(c for w, c in seen.items() if any(map(str.isdigit, w))), sum(c for w, c in seen.items() if w[0].isupper())]


def _tally(text: str, before: str | None = None) -> Tally:
    words = text.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    follow = words if before is None else [before, *words]
    return Tally(np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256), len(words),
                 [int(lengths.sum()), int((lengths * lengths).sum()), int(lengths.max(initial=0))], int((lengths <= 3).sum()),
                 Counter(words), set(zip(follow, follow[1:])), sum(map(str.__eq__, follow, follow[1:])),
                 text.count("http://") + text.count("https://") + text.count("www."), words[-1] if words else None)


def _pieces(text: str) -> Iterator[str]:
    """A long text cut after line ends."""
    at = 0
    while at < len(text):
        end = text.find("\n", at + PART)
        end = len(text) if end < 0 else end + 1
        yield text[at:end]
        at = end


def _lines(pieces: Iterable[str]) -> tuple[int, int]:
    """Lines that are not blank, and how many different ones there are."""
    n, different = 0, []
    for piece in pieces:
        lines = [line for line in piece.split("\n") if line.strip()]
        n += len(lines)
        different.append(set(lines))
        if len(different) > 1 or len(piece) > PART:
            different[-1] = np.fromiter(map(hash, different[-1]), np.int64, len(different[-1]))
            if len(different) == 2 and isinstance(different[0], set):
                different[0] = np.fromiter(map(hash, different[0]), np.int64, len(different[0]))
    return n, len(different[0]) if len(different) == 1 else len(np.unique(np.concatenate(different))) if different else 0


def _measured(tallies: list[Tally], n_lines: int, n_different: int) -> list[float]:
    one = tallies[0]
    if len(tallies) == 1 and isinstance(one.seen, Counter):
        distinct, commonest, once = len(one.seen), max(one.seen.values(), default=0), sum(c == 1 for c in one.seen.values())
        pairs, kinds = len(one.pairs), one.kind_counts()
    else:
        _, at = np.unique(np.concatenate([t.seen[0] for t in tallies]), return_inverse=True)
        times = np.bincount(at, np.concatenate([t.seen[1] for t in tallies]))
        distinct, commonest, once = len(times), int(times.max(initial=0)), int((times == 1).sum())
        pairs, kinds = len(np.unique(np.concatenate([t.pairs for t in tallies]))), np.sum([t.kinds for t in tallies], axis=0).tolist()
    counts, words, short, links, repeated = (sum(getattr(t, f) for t in tallies) for f in ("data", "words", "short", "links", "repeated"))
    size, k = int(counts.sum()), max(1, words)
    n = max(1, size)
    letters, squares = (sum(t.letters[i] for t in tallies) for i in (0, 1))
    mean = letters / k
    shares = counts[counts > 0] / n
    marks = int(counts[_SENTENCE_MARKS].sum())
    return [
        math.log1p(size), math.log1p(words), math.log1p(n_lines),
        counts[_UPPER].sum() / max(1, counts[_UPPER].sum() + counts[_LOWER].sum()), counts[_DIGIT].sum() / n,
        counts[128:].sum() / n, marks / k, counts[_OTHER_MARKS].sum() / k, counts[33] / k,
        (counts[32] + counts[9:14].sum()) / n, float(-(shares * np.log2(shares)).sum()) if size else 0.0,
        mean, math.sqrt(max(0.0, squares / k - mean * mean)), math.log1p(max(t.letters[2] for t in tallies)),
        short / k, distinct / k, commonest / k, once / k, 1 - pairs / (words - 1) if words > 1 else 0.0,
        1 - n_different / n_lines if n_lines else 0.0, k / max(1, n_lines), kinds[0] / k, kinds[1] / k, kinds[2] / k, repeated / k,
        k / (1 + int(counts[46] + counts[33] + counts[63])), links / k, kinds[3] / k,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float32).reshape(-1, len(STATISTICS))


@dataclass
class Trees:
    """Trees of one depth as arrays: [tree, inner node] feature and threshold, [tree, leaf] value."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all trees step down together, level by level."""
        if not len(self.leaf):
            return np.full(len(x), 1 / (1 + math.exp(-self.start)))
        out = np.empty(len(x))
        trees, depth = np.arange(len(self.leaf)), int(self.leaf.shape[1]).bit_length() - 1
        for at in range(0, len(x), 4096):
            rows = x[at:at + 4096]
            node = np.zeros((len(rows), len(trees)), np.int64)
            each = np.arange(len(rows))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (rows[each, self.feature[trees, node]] > self.threshold[trees, node])
            out[at:at + 4096] = self.start + self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, rate: float = 0.1, bins: int = 64,
          least_rows: int = 10, l2: float = 1.0) -> Trees:
    """Fit to labels from 0 to 1 by log loss. Each split is the best of a histogram's edges; ties go to the first.

    Without rows the score is 0.5, with one class only it is that class's smoothed share.
    """
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    start = math.log(share / (1 - share))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if n < 2 * least_rows or y.min() == y.max():
        return Trees(start, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # x <= edges[bin]
    usable = np.zeros((width, bins), bool)
    for f, e in enumerate(edges):
        usable[f, :len(e)] = True
    cell = binned + np.arange(width) * bins
    features, thresholds, values = (np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves)))
    margin = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2 ** level - 1, 2 ** level
            place = ((node - first)[:, None] * (width * bins) + cell).ravel()
            G, H, N = (np.bincount(place, w, many * width * bins).reshape(many, width, bins).cumsum(axis=2)
                       for w in (np.repeat(g, width), np.repeat(h, width), None))
            all_g, all_h, all_n = G[:, :1, -1:], H[:, :1, -1:], N[:, :1, -1:]
            gain = G ** 2 / (H + l2) + (all_g - G) ** 2 / (all_h - H + l2) - all_g ** 2 / (all_h + l2)
            gain[~((N >= least_rows) & (all_n - N >= least_rows) & usable)] = -np.inf
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(many, -1)[np.arange(many), best] > 1e-9):
                f, b = divmod(int(best[k]), bins)
                features[t, first + k], thresholds[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        values[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += values[t, leaf]
    return Trees(start, features, thresholds, values)


def held_out(doc_id: Column) -> Column:
    """Rows that learning must not see: crc32 of the id as text has remainder 1 by 3. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Learn ``labels.quality`` from the whole texts of up to ``max_rows`` labelled documents that are not held out.

    Which of them is decided by a hash of the id. ``max_rows`` bounds the labels that are broadcast and the rows of
    statistics that reach the driver (``len(STATISTICS)`` floats each). A document with several labels counts once,
    with their mean; null ids and null labels are left out. Only the text is an input.
    """
    short_batches(docs.sparkSession)
    known = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_label"))
                   .where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out(F.col("_id")))
                   .groupBy("_id").agg(F.avg("_label").alias("_label"))
                   .orderBy(F.xxhash64("_id"), "_id").limit(max_rows))

    @F.pandas_udf(", ".join(f"{s} float" for s in STATISTICS))
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(matrix(list(texts)), columns=STATISTICS)

    texts = docs.select(docs["doc_id"].alias("_id"), text_column(docs).alias("_text"))
    rows = (texts.join(F.broadcast(known), "_id").select("_id", "_label", measured("_text").alias("m"))
                 .select("_id", "_label", "m.*").orderBy(F.xxhash64("_id"), "_id", *STATISTICS).limit(max_rows)).toPandas()
    return boost(rows[STATISTICS].to_numpy(np.float32), rows["_label"].to_numpy(np.float64))


def score_quality(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """``docs`` with a score (0 to 1, higher: label 1 likelier) of the whole text; null texts count as empty.

    One pass without shuffle; the model travels with the task. A column called ``name`` is replaced.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(trees.score(matrix(list(texts))))

    return docs.withColumn(name, score(text_column(docs)))
