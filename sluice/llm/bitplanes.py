"""Token id files: blocks of ids turned into bit planes, each compressed alone, behind an index of chunks.

A file holds the documents of one range of the order:

    magic | plane ... plane | document table | index | length of index (8 bytes) | magic

A block is up to ``BLOCK`` ids. Bit plane k holds bit k of each id of the block, eight ids a byte, zstandard
compressed; planes beyond the largest id are not stored. The index (zstandard compressed JSON) has for each block
its number of ids and the place and length of its planes, and the place of the document table: number of ids and
doc_id of each document.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sluice.llm.text import bare_words, groups, parts, short_batches, text_column
from sluice.workdir import new_path

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16


def _turned(words: np.ndarray) -> np.ndarray:
    """Each 64-bit word as an 8 x 8 matrix of bits, one byte a row, transposed: bit k of byte j becomes bit j of byte k."""
    x = words.copy()
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x ^= t ^ (t << np.uint64(shift))
    return x


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Bit planes of unsigned 32-bit ids, lowest first, as many as the largest id needs."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    octets, n8 = (width + 7) // 8, (len(ids) + 7) // 8
    low = np.zeros((octets, n8 * 8), np.uint8)
    low[:, :len(ids)] = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :octets].T
    planes = _turned(low.view("<u8")).view(np.uint8).reshape(octets, n8, 8).transpose(0, 2, 1).reshape(octets * 8, n8)
    return [planes[k].tobytes() for k in range(width)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    octets, n8 = (len(planes) + 7) // 8, (n + 7) // 8
    rows = np.zeros((octets * 8, n8), np.uint8)
    for k, plane in enumerate(planes):
        rows[k] = np.frombuffer(plane, np.uint8)
    low = _turned(np.ascontiguousarray(rows.reshape(octets, 8, n8).transpose(0, 2, 1)).view("<u8").reshape(octets, n8)).view(np.uint8)
    out = np.zeros((n, 4), np.uint8)
    out[:, :octets] = low[:, :n].T
    return out.reshape(-1).view("<u4")


class IdWriter:
    """Writes one file; holds one block of ids and the document table."""

    def __init__(self, sink, block: int = BLOCK, level: int = 1):
        import zstandard

        self.sink, self.block, self.pack = sink, block, zstandard.ZstdCompressor(level=level).compress
        self.at, self.held, self.n_held, self.blocks = 0, [], 0, []
        self.names: list[int | None] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> list[int]:
        self.sink.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.names.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            ids = np.concatenate(self.held)
            whole = len(ids) // self.block * self.block
            for k in range(0, whole, self.block):
                self._block(ids[k:k + self.block])
            self.held, self.n_held = [ids[whole:].copy()], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append([len(ids), [self._put(self.pack(p)) for p in to_planes(ids)]])

    def close(self) -> int:
        """Finish the file; the number of ids in it."""
        if self.n_held:
            self._block(np.concatenate(self.held))
        table = np.array([[n is not None, n or 0, k] for n, k in zip(self.names, self.lengths)], "<i8").tobytes()
        index = self.pack(json.dumps({"blocks": self.blocks, "documents": self._put(self.pack(table))}).encode())
        self._put(index)
        self._put(len(index).to_bytes(8, "little") + MAGIC)
        return sum(self.lengths)


def read_file(source, size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of an open file, in order; one block and one document are held."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress

    def get(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    tail = get(size - 16, 16)
    if tail[8:] != MAGIC or get(0, 8) != MAGIC:
        raise ValueError("not a whole file of token ids")
    n_index = int.from_bytes(tail[:8], "little")
    index = json.loads(unpack(get(size - 16 - n_index, n_index)))
    blocks = (from_planes([unpack(get(*p)) for p in planes], n) for n, planes in index["blocks"])
    rest = np.zeros(0, "<u4")
    for known, name, n in np.frombuffer(unpack(get(*index["documents"])), "<i8").reshape(-1, 3):
        got = [rest]
        have = len(rest)
        while have < n:
            got.append(next(blocks))
            have += len(got[-1])
        ids = got[0] if len(got) == 1 else np.concatenate(got)
        yield (int(name) if known else None), ids[:n]
        rest = ids[n:]


# Characters that lower-case and normalise one by one and whose kind (letter, digit, mark, white space) is plain.
_LETTERS, _SPACES = "a-z\xdf-\xf6\xf8-\xff", "\t-\r "
_strange = re.compile(f"[^!-~A-Z\xc0-\xd6\xd8-\xde\u2010-\u2027{_LETTERS}{_SPACES}]|<[|]")
#: What the file of such a tokenizer says before its model, a fixed value.
_PLAN = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Its pattern on lower-cased texts of such characters.
_runs = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_SPACES}{_LETTERS}0-9]+")


class WordIds:
    """Ids (as bytes) of texts for a tokenizer that lower-cases, drops white space and never joins words across it.

    ``apart`` tells whether the file describes such a tokenizer; for any other one whole texts go through the library.
    Texts of plain characters are cut into the tokenizer's own pieces; letters go straight to its model, other pieces
    through all of it. Texts with other characters or with what begins a special string go through it word by word.
    Each distinct piece or word is encoded when first met; the tables are emptied at a bound.
    """

    def __init__(self, path: str, most: int = 600_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.apart = (all(spec.get(k) == v for k, v in _PLAN.items()) and spec.get("post_processor") is None and spec["model"]["type"] == "BPE"
                      and not spec["model"].get("dropout") and not any(
                          t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].startswith("<|") for t in spec.get("added_tokens") or []))
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}
        model = tokenizer.model

        def whole(text: str) -> bytes:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        def piece(run: str) -> bytes:
            if not run.isalpha():
                return whole(run)
            return array("I", [t.id for t in model.tokenize(run if run.isascii() else run.translate(shown))]).tobytes()

        self.whole, self.pieces, self.words = whole, Known(piece, most, longest), Known(whole, most // 4, longest)

    def encode(self, text: str) -> bytes:
        if not self.apart:
            return self.whole(text)
        if _strange.search(text):
            return b"".join(map(self.words.__getitem__, bare_words(text)))
        return b"".join(map(self.pieces.__getitem__, _runs.findall(text.lower())))


class Known(dict):
    """What ``compute`` gives for keys, kept for short keys up to a bound."""

    def __init__(self, compute, most: int, longest: int):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest

    def __missing__(self, key: str) -> bytes:
        found = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = found
        return found


@lru_cache(maxsize=4)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode_words(table: WordIds, texts: list[str], end_id: int | None) -> list[np.ndarray]:
    """Ids of whole texts; long ones are taken in parts where words are encoded apart."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    return [np.frombuffer(b"".join(map(table.encode, parts(text) if table.apart else [text])) + end, "<u4") for text in texts]


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, block: int = BLOCK,
              text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode ``text`` of all ``docs``, write token files in ascending order of ``key``; returns their manifest.

    Words are encoded apart, once per worker, if the file of ``tokenizer`` tells that it drops white space; any other
    tokenizer of the library gets whole texts. Documents are dealt by range of
    ``key`` (ties by text, null keys first) and each task streams its sorted range to one file in ``folder``, a
    place that pyarrow's file systems and all executors reach. File names carry a random part and the manifest
    (file, part, n_docs, n_ids) names only files that were closed by tasks whose rows Spark kept: a repeated task
    writes another file, and what a lost one left is never read. Null texts have no ids but ``end_id``. An empty
    table gives no file.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), text_column(docs, text).alias("text"))
    order = ["doc_id", F.length("text"), F.xxhash64("text")]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        table, writer, part = _word_ids(tokenizer), None, TaskContext.get().partitionId()
        path = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.bin"
        for rows in batches:
            if writer is None and len(rows):
                system, place = FileSystem.from_uri(path)
                system.create_dir(place.rpartition("/")[0])
                sink = system.open_output_stream(place)
                writer = IdWriter(sink, block)
            names = iter(rows.doc_id.astype(object).where(rows.doc_id.notna(), None))
            for some in groups(list(rows.text)):
                for ids in encode_words(table, some, end_id):
                    name = next(names)
                    writer.add(None if name is None else int(name), ids)
        if writer is not None:
            n = writer.close()
            sink.close()
            yield pd.DataFrame({"file": [path], "part": [part], "n_docs": [len(writer.names)], "n_ids": [n]})

    return (rows.repartitionByRange(*order).sortWithinPartitions(*order)
                .mapInPandas(write, "file string, part long, n_docs long, n_ids long"))


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with start: ids in all files before. One row per file meets in the window, no document does."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) from the written files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for file, start in zip(files.file, files.start):
                system, place = FileSystem.from_uri(file)
                out: list[tuple] = []
                held = 0
                with system.open_input_file(place) as source:
                    for name, ids in read_file(source, source.size()):
                        out.append((name, start, ids.tobytes()))
                        start += len(ids)
                        held += len(ids)
                        if held > 1 << 20 or len(out) >= 2048:
                            yield _frame(out)
                            out, held = [], 0
                if out:
                    yield _frame(out)

    files = with_starts(manifest).select("file", "start")
    n = max(1, manifest.count())
    return files.repartition(n).mapInPandas(read, "doc_id long, start long, ids binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names, starts, ids = zip(*rows)
    return pd.DataFrame({"doc_id": pd.array(names, dtype="Int64"), "start": starts, "ids": ids})


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that executors share, as pyarrow's file systems take it."""
    path = new_path(spark, name)
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
