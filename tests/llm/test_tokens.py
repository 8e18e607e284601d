"""Token counts, SentencePiece ids and id files against the libraries on whole texts."""

import hashlib
import io
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from sluice.llm import bitplanes, pieces, text, token_counts
from sluice.llm.queries import QUERIES, tokenizer_file
from texts import odd_texts

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("n_tokens", T.StringType()), T.StructField("ids", T.StringType())])


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def sp():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(texts)], DOCS)


def test_cuts_lose_nothing():
    for t in odd_texts(300):
        assert "".join(text.led_words(t)) == t
        assert "".join(text.parts(t, 5)) == t
        assert [w for p in text.parts(t, 5) for w in text.led_words(p)] == text.led_words(t)


def test_counts_equal_library(byte_bpe, word_bpe, sp):
    texts = odd_texts(3000)
    for file, cuts, want in (("byte_bpe_50k.json", True, [len(e) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]),
                             ("word_bpe_49k.json", False, [len(e) for e in word_bpe.encode_batch(texts, add_special_tokens=False)]),
                             ("piece_bpe_32k.model", False, [len(i) for i in sp.encode(texts)])):
        lengths = token_counts.lengths_of(tokenizer_file(file))
        assert lengths.cuts == cuts
        assert lengths.count(texts) == want
        assert lengths.count(texts, batch_bytes=50, part=7) == want


def test_batches_hold_even_bytes():
    pieces = ["\u20ac" * 4, "a", "", "b" * 30, "cc", "\u20ac", "d" * 9]
    batches = list(token_counts.byte_batches(pieces, 12))
    assert sorted(at for some in batches for at in some) == list(range(7))
    assert all(len(some) == 1 or sum(len(pieces[at].encode()) for at in some) <= 12 for some in batches)
    assert [len(some) for some in batches] == [4, 1, 1, 1]
    assert list(token_counts.byte_batches([], 12)) == []


def test_small_table_gives_the_same(byte_bpe):
    table = text.PieceTable(lambda some: [len(e) for e in byte_bpe.encode_batch(some, add_special_tokens=False)], limit=3, longest=2, batch_bytes=5)
    texts = odd_texts(50)
    lists = [text.led_words(t) for t in texts]
    assert [sum(map(table.learn([words]).__getitem__, words)) for words in lists] == [len(e) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_equal_library(word_bpe):
    table = bitplanes._word_ids(tokenizer_file("word_bpe_49k.json"))
    texts = odd_texts(3000)
    want = [e.ids + [1] for e in word_bpe.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bitplanes.encode_words(table, texts, 1)] == want


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_any_tokenizer(file, byte_bpe, word_bpe):
    library = byte_bpe if file.startswith("byte") else word_bpe
    table = bitplanes._word_ids(tokenizer_file(file))
    assert table.apart == file.startswith("word")
    texts = ["Hello World", *odd_texts(300)]
    got = bitplanes.encode_words(table, texts, None)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_piece_ids_equal_library(sp):
    words = pieces.MarkedWords(tokenizer_file("piece_bpe_32k.model"))
    assert words.separable
    texts = odd_texts(3000)
    got = words.encode(texts)
    assert [g[0] for g in got] == sp.encode(texts)
    assert [g[1] for g in got] == [",".join(map(str, x)) for x in sp.encode(texts)]
    for t in texts:
        assert [i for p in pieces.marked_parts(t, 4) for i in words.encode([p])[0][0]] == sp.encode(t), repr(t)


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 49408, 1 << 24, 1 << 32):
        for n in (0, 1, 7, 8, 9, 1000):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
            assert (bitplanes.from_planes(bitplanes.to_planes(ids), n) == ids).all()


def test_file_round_trip_with_small_blocks():
    rng = np.random.default_rng(2)
    given = [(None if k == 0 else k, rng.integers(0, 70000, n).astype("<u4")) for k, n in enumerate([5, 0, 64, 65, 200, 1, 0])]
    out = io.BytesIO()
    writer = bitplanes.IdWriter(out, block=64)
    for name, ids in given:
        writer.add(name, ids)
    assert writer.close() == sum(len(i) for _, i in given)
    data = out.getvalue()
    got = list(bitplanes.read_file(io.BytesIO(data), len(data)))
    assert [n for n, _ in got] == [n for n, _ in given]
    assert all((a == b).all() for (_, a), (_, b) in zip(got, given))
    with pytest.raises(ValueError):
        list(bitplanes.read_file(io.BytesIO(data[:-1]), len(data) - 1))


def brute(name, texts, byte_bpe, word_bpe, sp):
    if name.startswith("op7"):
        n = [len(e) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]
        return pd.DataFrame({"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > 512 for x in n]})
    if name.startswith("op6"):
        ids = [np.array(e.ids + [1], "<u4") for e in word_bpe.encode_batch(texts, add_special_tokens=False)]
        n = np.array([len(i) for i in ids])
        return pd.DataFrame({"start": n.cumsum() - n, "n_tokens": n, "ids_crc32": [zlib.crc32(i.tobytes()) for i in ids]})
    ids = [sp.encode(t) for t in texts]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return pd.DataFrame({"n_tokens": [len(i) for i in ids], "ids_sha256": [digest(",".join(map(str, i))) for i in ids],
                         "decoded_sha256": [digest(sp.decode(i)) for i in ids]})


@pytest.mark.parametrize("name", ["op6_token_id_output", "op7_token_counts", "op9_sentencepiece"])
def test_registered(spark, name, byte_bpe, word_bpe, sp):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    want = brute(name, given.text.fillna("").tolist(), byte_bpe, word_bpe, sp)
    want.insert(0, "doc_id", given.doc_id.to_numpy())
    got = QUERIES[name](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)[list(want.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", ["op6_token_id_output", "op7_token_counts", "op9_sentencepiece"])
def test_odd_tables(spark, tmp_path, name, byte_bpe, word_bpe, sp):
    texts = [None, "", *odd_texts(40), "again", "again"]
    for given in ([], texts):
        docs(spark, given).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = QUERIES[name](spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
        want = brute(name, [t or "" for t in given], byte_bpe, word_bpe, sp)
        assert len(got) == len(given)
        for c in want.columns:
            assert got[c].tolist() == want[c].tolist(), c


def test_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "b c", "", ""), (None, "a", "", ""), (3, "x", "", ""), (3, "x", "", ""), (-1, None, "", "")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op6_token_id_output"](spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (None, 2, 3), (-1, 5, 1), (3, 6, 2), (3, 8, 2)]


def test_operators_replace_clashing_columns(spark):
    got = pieces.encode_pieces(docs(spark, ["a b"]), tokenizer_file("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert got.select("decoded", F.size("ids").alias("n")).first() == ("a b", 2)
    assert token_counts.count_tokens(docs(spark, ["a b"]), tokenizer_file("byte_bpe_50k.json")).first().n_tokens == 2
