"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sluice.llm.text import parts, short_batches, text_column

#: UTF-8 bytes that go to the tokenizer at once, unless one part of a text alone is longer.
BATCH_BYTES = 1 << 20
#: Characters of a part of a long text.
PART = 1 << 18


class Lengths:
    """Number of tokens of each of a list of texts; ``cuts`` tells whether texts may be cut before white space."""

    def __init__(self, path: str):
        self.encode, self.cuts = _sentencepiece(path) if path.endswith(".model") else _tokenizers(path)

    def count(self, texts: list[str], batch_bytes: int = BATCH_BYTES, part: int = PART) -> list[int]:
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for piece in parts(text, part) if self.cuts and len(text) > part else (text,):
                pieces.append(piece)
                owner.append(i)
        counts = [0] * len(texts)
        for batch in byte_batches(pieces, batch_bytes):
            for at, n in zip(batch, self.encode([pieces[at] for at in batch])):
                counts[owner[at]] += n
        return counts


def _tokenizers(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], _cuts_are_safe(path)


def _sentencepiece(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False


def _cuts_are_safe(path: str) -> bool:
    """Whether no token ever holds the end of a word and the white space after it.

    So it is for byte-level pieces by the usual pattern, in which white space only leads, with special strings that
    hold no white space and take none beside them.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"])
                for t in spec.get("added_tokens") or [])
    return (plain and spec.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space", True))


def byte_batches(pieces: list[str], most: int) -> Iterator[list[int]]:
    """Places of ``pieces`` in batches of like lengths and up to ``most`` UTF-8 bytes, or one longer piece."""
    sizes = [len(p.encode("utf-8", "surrogatepass")) for p in pieces]
    some, held = [], 0
    for at in sorted(range(len(pieces)), key=sizes.__getitem__):
        if some and held + sizes[at] > most:
            yield some
            some, held = [], 0
        some.append(at)
        held += sizes[at]
    if some:
        yield some


@lru_cache(maxsize=4)
def lengths_of(path: str) -> Lengths:
    return Lengths(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of column ``text``.

    ``tokenizer`` is a file of the tokenizers library (.json) or of sentencepiece (.model). The texts of an Arrow batch
    are encoded in batches of even bytes and only lengths return. Long texts are cut before white space where the
    tokenizer's pattern lets it only lead a token; other tokenizers get them whole. Special strings in a text are
    handled as the library does by default.
    Null texts count as empty: 0 bytes, 0 tokens. Columns of ``docs`` named like the new ones are replaced. Repeated
    rows stay; an empty table gives an empty one. No shuffle, one pass; a lost task is simply run again.
    """
    short_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = lengths_of(tokenizer)
        for texts in batches:
            yield pd.Series(lengths.count(list(texts)), dtype="int64")

    body = text_column(docs, text)
    return (docs.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_tokens": n_tokens(body)})
            .withColumn("over_limit", F.col("n_tokens") > limit))
