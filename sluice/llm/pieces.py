"""SentencePiece ids and decoded texts by a table of distinct marked words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sluice.llm.text import PART, PieceTable, groups, short_batches, text_column

MARK = "▁"


class MarkedWords:
    """Encoder of whole texts by words, for a model whose pieces never go on past a white-space marker.

    The library puts a marker before the text and turns each space into one. If no piece holds a marker after
    another character, no merge crosses from a word into the markers after it, so each run of markers with its
    word is segmented alone. Cutting a text before such a run and dropping one space gives texts that the library
    encodes, with the marker it adds, to exactly the ids of that run.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.separable = (not any(MARK in p.lstrip(MARK) for p in pieces)
                          and self.model.encode("a b  c") == [*self.model.encode("a"), *self.model.encode("b"), *self.model.encode(" c")]
                          and self.model.encode(" a", out_type=str)[0].startswith(MARK))
        self.ids = list(range(self.model.vocab_size()))  # one object for each id
        self.table = PieceTable(self._segment)
        self.lone = self._value([self.model.piece_to_id(MARK)])

    def _value(self, ids: list[int]) -> tuple[tuple[int, ...], str]:
        return tuple(self.ids[i] for i in ids), ",".join(map(str, ids))

    def _segment(self, words: list[str]) -> list[tuple[tuple[int, ...], str]]:
        return [self._value(ids) if w else self.lone for w, ids in zip(words, self.model.encode(words, num_threads=1))]

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """For each text its ids and their decimals joined by commas."""
        if not self.separable:
            return [(ids, ",".join(map(str, ids))) for ids in self.model.encode(texts, num_threads=1)]
        if len(texts) == 1 and len(texts[0]) > PART:
            found = [self._by_words([part])[0] for part in marked_parts(texts[0])]
            return [(list(chain.from_iterable(f[0] for f in found)), ",".join(f[1] for f in found))]
        return self._by_words(texts)

    def _by_words(self, texts: list[str]) -> list[tuple[list[int], str]]:
        out = []
        lists = [marked_words(t) for t in texts]
        of = self.table.learn(lists).__getitem__
        for words in lists:
            found = list(map(of, words))
            out.append((list(chain.from_iterable(f[0] for f in found)), ",".join([f[1] for f in found])))
        return out


_edge = re.compile(f"(?<=[^ {MARK}])[ {MARK}](?=.)", re.S)


def marked_parts(text: str, size: int = PART) -> Iterator[str]:
    """A long text cut before markers that follow a word, without the marker that the library adds again."""
    at = 0
    while len(text) - at > size and (edge := _edge.search(text, at + size)):
        yield text[at:edge.start()]
        at = edge.end()
    yield text[at:]


def marked_words(text: str) -> list[str]:
    """Words of a text with the spaces before them but the first one; a lone last space gives an empty word."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, empty = [], 0
    for w in words:
        if w:
            out.append(" " * empty + w)
            empty = 0
        else:
            empty += 1
    if empty:
        out.append(" " * (empty - 1))
    return out


@lru_cache(maxsize=4)
def _words(path: str) -> MarkedWords:
    return MarkedWords(path)


def encode_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (array of all ids of ``text``) and decoded (the library's decoding of these ids).

    Ids equal those of the sentencepiece library for the whole text, without begin or end ids. Each distinct marked
    word is segmented once per worker; ids are joined back by position. A model with pieces that cross markers is
    used on whole texts instead. Null texts count as empty: no ids, empty text. Columns named like the new ones are
    replaced. One pass without shuffle.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("ids array<int>, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _words(model)
        for texts in batches:
            ids = [found[0] for some in groups(list(texts)) for found in words.encode(some)]
            yield pd.DataFrame({"ids": ids, "decoded": words.model.decode(ids) if ids else []})

    return _spread(docs, both(text_column(docs, text)), ["ids", "decoded"])


def digest_pieces(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Like ``encode_pieces`` with n_tokens, ids_sha256 (of decimals joined by commas) and decoded_sha256 instead.

    For checks over whole corpora: only digests leave the workers.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _words(model)
        for texts in batches:
            rows = []
            for some in groups(list(texts)):
                found = words.encode(some)
                decoded = words.model.decode([ids for ids, _ in found])
                rows += [(len(ids), sha256(shown), sha256(back)) for (ids, shown), back in zip(found, decoded)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return _spread(docs, digests(text_column(docs, text)), ["n_tokens", "ids_sha256", "decoded_sha256"])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _spread(docs: DataFrame, made, names: list[str]) -> DataFrame:
    held = max(docs.columns, key=len) + "_made"
    return docs.withColumn(held, made).withColumns({n: F.col(f"`{held}`.{n}") for n in names}).drop(held)
