"""Alignment of the tokens of two tokenizers over the same bytes, and how often the corpus links two ids."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from sluice.llm.pieces import MARK, MarkedWords
from sluice.llm.text import SPACE, PieceTable, short_batches, text_column
from sluice.workdir import materialize

#: Characters that are aligned at once, and that a block of documents holds (or one longer document).
BLOCK = 1 << 19

_odd = re.compile(f"[{SPACE[:5]}{SPACE[6:]}{MARK}]|  |^ | $")
_edge = re.compile(f"(?<=[^{SPACE}{MARK}]) (?=.)", re.S)


def units(text: str) -> list[str]:
    """``text`` cut at spaces that follow a word, without these spaces.

    A space before each unit gives a space and the text. Neither tokenizer joins anything across such a cut: one
    starts a new piece with the space, the other puts its marker there.
    """
    return _edge.split(text) if _odd.search(text) else text.split(" ")


def unit_groups(text: str, size: int = BLOCK) -> Iterator[list[str]]:
    """The units of a text, in lists of up to about ``size`` characters."""
    at = 0
    while len(text) - at > size and (edge := _edge.search(text, at + size)):
        yield units(text[at:edge.start()])
        at = edge.end()
    yield units(text[at:] if at else text)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: shown bytes as they are, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenPair:
    """Ids of both tokenizers for units, each unit encoded when first met, and the bytes of every id."""

    def __init__(self, byte_file: str, piece_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_file)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        words = MarkedWords(piece_file)
        if not words.separable:
            raise ValueError(f"pieces of {piece_file} go on past a marker; texts can't be cut at spaces")
        self.b = words.model
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i in range(self.b.vocab_size()) for p in [self.b.id_to_piece(i)]]
        self.a_length, self.b_length = (np.array([len(x) for x in some], np.int64) for some in (self.a_bytes, self.b_bytes))
        self.digits = Digits(max(len(self.a_bytes), len(self.b_bytes)))
        self.table = PieceTable(self._encode, limit=500_000)

    def _encode(self, some: list[str]) -> Iterator[tuple[bytes, bytes, bool]]:
        """Ids of both sides of each unit, and whether the bytes of both are those of the unit after a space."""
        whole = [(" " + u).encode() for u in some]
        size, joined = np.fromiter(map(len, whole), np.int64, len(whole)), b"".join(whole)
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in some], add_special_tokens=False)]
        sides, same = [], np.ones(len(some), bool)
        for lists, shown, length in ((a, self.a_bytes, self.a_length), (self.b.encode(some, num_threads=1), self.b_bytes, self.b_length)):
            upto = np.append(0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))
            ids = np.fromiter(chain.from_iterable(lists), np.int32, upto[-1])
            ends = np.append(0, np.cumsum(length[ids]))[upto]
            if not ((np.diff(ends) == size).all() and b"".join(map(shown.__getitem__, ids)) == joined):
                same &= [b"".join(map(shown.__getitem__, x)) == w for x, w in zip(lists, whole)]
            packed, cut = ids.tobytes(), (4 * upto).tolist()
            sides.append([packed[i:j] for i, j in zip(cut, cut[1:])])
        return zip(*sides, same.tolist())

    def encode(self, lists: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """For each list of units the ids of both sides, and whether the bytes of each unit are those of both."""
        known = self.table.learn(lists).__getitem__
        out = []
        for some in lists:
            a, b, same = zip(*map(known, some))
            out.append((np.frombuffer(b"".join(a), np.int32), np.frombuffer(b"".join(b), np.int32), all(same)))
        return out

    def same_bytes(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        whole = (" " + text).encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))


class Digits:
    """Decimals of many ids, each with a character after it, as one run of bytes."""

    def __init__(self, top: int):
        shown = [str(i).encode() for i in range(top)]
        self.width = max(map(len, shown)) + 1
        self.length = np.array([len(s) for s in shown])
        self.rows = np.frombuffer(b"".join(s.ljust(self.width) for s in shown), np.uint8).reshape(top, self.width)

    def run(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where each id's bytes end."""
        rows, length = self.rows[ids], self.length[ids]
        rows[np.arange(len(ids)), length] = after
        return rows[np.arange(self.width) <= length[:, None]], np.cumsum(length + 1)


class Aligned:
    """Links and groups of the tokens of some documents whose bytes are the same on both sides."""

    def __init__(self, pair: TokenPair, a: list[np.ndarray], b: list[np.ndarray]):
        self.pair, self.docs = pair, len(a)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        self.a, self.b = (np.concatenate(ids) if ids else np.zeros(0, np.int32) for ids in (a, b))
        each = np.arange(self.docs)
        a_doc, b_doc = np.repeat(each, self.n_a), np.repeat(each, self.n_b)
        # Bytes of both sides agree document by document, so places in the run of all documents do too.
        self.a_end, self.b_end = np.cumsum(pair.a_length[self.a]), np.cumsum(pair.b_length[self.b])
        left = pd.DataFrame({"at": self.a_end - pair.a_length[self.a], "doc": a_doc, "a": np.arange(len(self.a))})
        right = pd.DataFrame({"at": self.b_end - pair.b_length[self.b], "doc": b_doc, "b": np.arange(len(self.b))})
        covering = pd.merge_asof(left, right, on="at", by="doc")
        covered = pd.merge_asof(right, left, on="at", by="doc")
        begins_alone = left["at"].to_numpy()[covered["a"].to_numpy()] != right["at"].to_numpy()
        self.link_a = np.concatenate([left["a"].to_numpy(), covered["a"].to_numpy()[begins_alone]])
        self.link_b = np.concatenate([covering["b"].to_numpy(), right["b"].to_numpy()[begins_alone]])
        self.link_doc = a_doc[self.link_a]
        self.a_cut, self.b_cut = (self._both(x, y) for x, y in ((self.a_end, self.b_end), (self.b_end, self.a_end)))
        self.a_doc, self.b_doc = a_doc, b_doc

    @staticmethod
    def _both(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
        if not len(ends):
            return np.zeros(0, bool)
        return others[np.minimum(np.searchsorted(others, ends), len(others) - 1)] == ends

    def n_groups(self) -> np.ndarray:
        return np.bincount(self.a_doc[self.a_cut], minlength=self.docs)

    def n_links(self) -> np.ndarray:
        return np.bincount(self.link_doc, minlength=self.docs)

    def groups(self) -> list[bytes]:
        """For each document ``a1,a2|b1;a3|b2,b3``."""
        if not len(self.a):
            return [b""] * self.docs
        a_last, b_last = np.flatnonzero(self.a_cut), np.flatnonzero(self.b_cut)  # of each group
        a_group, b_group = np.cumsum(self.a_cut) - self.a_cut, np.cumsum(self.b_cut) - self.b_cut
        a_place = np.arange(len(self.a)) + np.append(0, b_last + 1)[a_group]
        b_place = np.arange(len(self.b)) + (a_last + 1)[b_group]
        ids, after = np.empty(len(self.a) + len(self.b), np.int32), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[a_place], ids[b_place] = self.a, self.b
        after[a_place[self.a_cut]], after[b_place[self.b_cut]] = ord("|"), ord(";")
        run, upto = self.pair.digits.run(ids, after)
        ends = np.append(0, upto)[np.append(0, np.cumsum(self.n_a + self.n_b))]
        shown = run.tobytes()
        return [shown[i:max(i, j - 1)] for i, j in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def _pair(byte_file: str, piece_file: str) -> TokenPair:
    return TokenPair(byte_file, piece_file)


def _portions(texts: list[str], size: int) -> Iterator[list[int]]:
    """Blocks of neighbouring texts that are not empty: of up to ``size`` characters together, or one longer text."""
    block, held = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        if block and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append(i)
        held += len(text)
    if block:
        yield block


def _aligned_block(pair: TokenPair, texts: list[str]) -> Iterator[tuple[list[int], Aligned]]:
    """The documents of a block, aligned; a long one in several parts. Those with other bytes are left out."""
    if len(texts) == 1 and len(texts[0]) > BLOCK:
        parts = [pair.encode([u])[0] for u in unit_groups(texts[0])]
        a, b = [p[0] for p in parts], [p[1] for p in parts]
        if all(p[2] for p in parts):
            for x, y in zip(a, b):
                yield [0], Aligned(pair, [x], [y])
        elif pair.same_bytes(texts[0], np.concatenate(a), np.concatenate(b)):
            yield [0], Aligned(pair, [np.concatenate(a)], [np.concatenate(b)])
        return
    coded = pair.encode([units(t) for t in texts])
    good = [i for i, (a, b, same) in enumerate(coded) if same or pair.same_bytes(texts[i], a, b)]
    yield good, Aligned(pair, [coded[i][0] for i in good], [coded[i][1] for i in good])


def align_tokens(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text") -> DataFrame:
    """``docs`` with a_ids, b_ids, links (positions of an A and a B token that overlap) and groups of column ``text``.

    A is the byte-level tokenizer on a space and the text, B the SentencePiece model, which adds that space itself.
    Special strings in a text are plain text. Each token start finds the token of the other side that covers it;
    both directions together are the links, from left to right. Places where tokens of both sides end cut them into
    groups, shown as ``a1,a2|b1;a3|b2,b3``. Null and empty texts, and those whose bytes the tokens of one side do
    not give back, have no tokens and empty groups. Columns named like the new ones are replaced. One pass, no shuffle.
    """
    short_batches(docs.sparkSession)
    kind = pa.struct([("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
                      ("links", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("groups", pa.string())])

    @F.arrow_udf("a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int>>, groups string")
    def aligned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = _pair(byte_file, piece_file)
        for batch in batches:
            texts = batch.to_pylist()
            out: list = [{"a_ids": [], "b_ids": [], "links": [], "groups": ""} for _ in texts]
            for block in _portions(texts, BLOCK):
                for found, some in _aligned_block(pair, [texts[i] for i in block]):
                    order = np.lexsort((some.link_b, some.link_a))
                    a_at, b_at, at = (np.append(0, np.cumsum(n)) for n in (some.n_a, some.n_b, some.n_links()))
                    for k, shown in enumerate(some.groups()):
                        row, i = out[block[found[k]]], order[at[k]:at[k + 1]]
                        row["links"] += [{"a": x, "b": y} for x, y in zip((some.link_a[i] - a_at[k] + len(row["a_ids"])).tolist(),
                                                                          (some.link_b[i] - b_at[k] + len(row["b_ids"])).tolist())]
                        row["a_ids"] += some.a[a_at[k]:a_at[k + 1]].tolist()
                        row["b_ids"] += some.b[b_at[k]:b_at[k + 1]].tolist()
                        row["groups"] += ";" * bool(row["groups"]) + shown.decode()
            yield pa.array(out, kind)

    held = max(docs.columns, key=len) + "_made"
    return docs.withColumn(held, aligned(text_column(docs, text))).withColumns(
        {f.name: F.col(f"`{held}`.{f.name}") for f in kind}).drop(held)


_PACKED = zstandard.ZstdCompressor(level=1)


def _pack(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending codes and how often each occurs, as planes of bytes of the steps and the times, compressed."""
    planes = np.stack([np.diff(codes, prepend=0), times]).astype("<u4").view(np.uint8).reshape(2 * len(codes), 4).T
    return _PACKED.compress(planes.tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    steps, times = np.ascontiguousarray(planes.T).view("<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int64), times.astype(np.int64)


_KEY_BITS = 40  # of an id pair: a * (ids of B) + b
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                     ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("packed", pa.binary()),
                     ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_COUNTED = ["n_a", "n_b", "n_groups", "n_links"]


def _block_rows(pair: TokenPair, block: int, names: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """A row for each document of a block and one, without packed, that has the id pairs of the block."""
    n = len(texts)
    counts = {c: np.zeros(n, np.int64) for c in _COUNTED}
    digests = [hashlib.sha256() for _ in texts]
    met: list[tuple[np.ndarray, np.ndarray]] = []  # document and id pair in one number, and times
    for found, some in _aligned_block(pair, texts):
        found = np.array(found, np.int64)
        for c, v in zip(_COUNTED, (some.n_a, some.n_b, some.n_groups(), some.n_links())):
            counts[c][found] += v
        for i, shown, before in zip(found, some.groups(), counts["n_groups"][found] > some.n_groups()):
            digests[i].update(b";" * bool(before) + shown)
        key = some.a[some.link_a].astype(np.int64) * len(pair.b_bytes) + some.b[some.link_b]
        met.append(np.unique((found[some.link_doc] << _KEY_BITS) | key, return_counts=True))
    if len(met) > 1:
        whole, at = np.unique(np.concatenate([m[0] for m in met]), return_inverse=True)
        met = [(whole, np.bincount(at, np.concatenate([m[1] for m in met])).astype(np.int64))]
    both, times = met[0] if met else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, codes = np.unique(both & ((1 << _KEY_BITS) - 1), return_inverse=True)
    at = np.searchsorted(both >> _KEY_BITS, np.arange(n + 1))
    packed = [_pack(codes[i:j], times[i:j]) for i, j in zip(at, at[1:])]
    shown = [d.hexdigest() if k else "" for d, k in zip(digests, counts["n_groups"])]
    rows = {"block": [block] * (n + 1), "doc_id": pa.concat_arrays([names, pa.nulls(1, pa.int64())]),
            **{c: np.append(v, 0) for c, v in counts.items()}, "groups_sha256": [*shown, ""], "packed": [*packed, None],
            "keys": [*[None] * n, keys], "times": [*[None] * n, np.bincount(codes, times, len(keys)).astype(np.int64)]}
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in _BLOCKS for x in [rows[f.name]]], schema=_BLOCKS)


def digest_alignment(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``.

    Tokens, links and groups are those of ``align_tokens``. The count of an id pair is the number of links of the whole
    corpus that hold it; count_sum adds it over the links of a row, and n_best counts links whose id pair no other
    pair of the same B id exceeds. Rows without tokens have zeros and an empty digest. Repeated rows count each time,
    null ids stay null; other columns of ``docs`` are not looked at. An empty table gives none.

    Each block of documents (bounded in characters; a longer document is a block) is aligned once and written with
    the distinct id pairs it holds, each once with its times, and each document's share in codes of that list. Counts
    are summed from these lists; what is known of a block's pairs goes back to it, not to each link. No id pair, however
    common, has more than one row a block, and no document more than one. The best count of each B id is broadcast: one
    row for an id, so the vocabulary bounds it.
    """
    short_batches(docs.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, block = _pair(byte_file, piece_file), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, names = batch["text"].to_pylist(), batch["doc_id"]
            empty = [i for i, t in enumerate(texts) if not t]
            for some in chain([empty] if empty else [], _portions(texts, BLOCK)):
                yield _block_rows(pair, block, names.take(pa.array(some)), [texts[i] for i in some])
                block += 1

    given = docs.select(docs[key].cast("long").alias("doc_id"), text_column(docs, text).alias("text"))
    kept = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, packed binary, "
            "keys array<long>, times array<long>")
    rows = materialize(given.mapInArrow(blocks, kept), "aligned-blocks")
    n_b = len(_pair(byte_file, piece_file).b_bytes)
    listed = rows.where("packed is null").select("block", F.posexplode(F.arrays_zip("keys", "times")).alias("code", "pair"))
    listed = listed.select("block", "code", F.col("pair.keys").alias("pair_key"), F.col("pair.times").alias("times"))
    counts = materialize(listed.groupBy("pair_key").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair_key") % n_b), "pair-counts")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))
    known = counts.join(F.broadcast(best), "b").select("pair_key", "n", (F.col("n") == F.col("most")).alias("best"))
    told = listed.select("block", "code", "pair_key").join(known, "pair_key").select(F.col("block").alias("of_block"), "code", "n", "best")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros((2, right.num_rows), np.int64)
        code = right["code"].to_numpy()
        n[code], best[code] = right["n"].to_numpy(), right["best"].to_numpy()
        sums = []
        for packed in left["packed"].to_pylist():
            codes, times = _unpack(packed)
            sums.append((int((best[codes] * times).sum()), int((n[codes] * times).sum())))
        out = left.drop_columns(["block", "packed"])
        return out.append_column("n_best", pa.array([s[0] for s in sums], pa.int64())).append_column(
            "count_sum", pa.array([s[1] for s in sums], pa.int64()))

    made = rows.where("packed is not null").drop("keys", "times")
    return (made.groupBy("block").cogroup(told.groupBy("of_block")).applyInArrow(
        summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"))
