"""Alignment of two tokenizers against the libraries on whole texts and comparing all tokens of a document."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import alignment
from sluice.llm.queries import QUERIES, tokenizer_file
from texts import odd_texts

SF = "/root/testdata/sf0.001"
FILES = ["byte_bpe_50k.json", "piece_bpe_32k.model"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(tokenizer_file(FILES[0]))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_file(FILES[1]))
    shown = {v: k for k, v in alignment.byte_alphabet().items()}
    assert decoders.ByteLevel().decode(["".join(shown[x] for x in "é🙂 \n\x00".encode())]) == "é🙂 \n\x00"
    return a, b


def plain(libraries, text):
    """Ids of both sides, links as positions, groups; None if the bytes differ."""
    a, b = libraries
    if not text:
        return None
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    alphabet = alignment.byte_alphabet()
    xs = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
    ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if not b"".join(xs) == b"".join(ys) == (" " + text).encode():
        return None
    ends = [np.cumsum([len(t) for t in some]).tolist() for some in (xs, ys)]
    starts = [[0, *e[:-1]] for e in ends]
    links, first = [], 0
    for i in range(len(x)):
        while ends[1][first] <= starts[0][i]:
            first += 1
        j = first
        while j < len(y) and starts[1][j] < ends[0][i]:
            links.append((i, j))
            j += 1
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        groups.append(",".join(map(str, x[i:k])) + "|" + ",".join(map(str, y[j:m])))
        i, j = k, m
    return x, y, links, groups


def expected(libraries, texts):
    made = [plain(libraries, t) for t in texts]
    counts = Counter((x[i], y[j]) for m in made if m for x, y, links, _ in [m] for i, j in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, links, groups = m
        ns = [counts[x[i], y[j]] for i, j in links]
        best = sum(n == most[y[j]] for n, (_, j) in zip(ns, links))
        out.append((len(x), len(y), len(groups), len(links), best, sum(ns), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [None, "", *odd_texts(300), "again", "again", "\n  a \n b\t c  ", "<|endoftext|> <s> x", "a▁b", "x" * 5000 + " y" * 2000]


def test_units_give_the_ids_of_the_library(libraries):
    pair = alignment._pair(*map(tokenizer_file, FILES))
    texts = [t for t in TEXTS + odd_texts(2000, 9) if t]
    for t, (a, b, _) in zip(texts, pair.encode([alignment.units(t) for t in texts])):
        assert a.tolist() == libraries[0].encode(" " + t, add_special_tokens=False).ids, repr(t)
        assert b.tolist() == libraries[1].encode(t), repr(t)
        assert [u for some in alignment.unit_groups(t, 5) for u in some] == alignment.units(t), repr(t)


@pytest.mark.parametrize("block", [alignment.BLOCK, 40])
def test_links_and_groups(spark, monkeypatch, libraries, block):
    """Also in small blocks, where most texts are longer than a block."""
    pair = alignment._pair(*map(tokenizer_file, FILES))
    monkeypatch.setattr(alignment, "BLOCK", block)
    groups = alignment.unit_groups
    monkeypatch.setattr(alignment, "unit_groups", lambda t: groups(t, block))
    texts = [t for t in TEXTS if t]
    want = [m for t in texts for m in [plain(libraries, t)] if m]
    rows, names = [], []
    for some in alignment._portions(texts, block):
        got = alignment._block_rows(pair, 0, alignment.pa.array(some, alignment.pa.int64()), [texts[i] for i in some]).to_pylist()
        rows += got[:-1]
        names += some
        assert sum(got[-1]["times"]) == sum(r["n_links"] for r in got)
        for r in got[:-1]:
            codes, times = alignment._unpack(r["packed"])
            assert times.sum() == r["n_links"] and (np.diff(codes) > 0).all()
    assert names == list(range(len(texts)))
    rows = [r for r in rows if r["n_a"]]
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in rows] == [
        (len(x), len(y), len(g), len(k), hashlib.sha256(";".join(g).encode()).hexdigest()) for x, y, k, g in want]


def test_real_outputs(spark, libraries):
    docs = spark.createDataFrame([(i, t, "old", "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, links string, other string")
    got = alignment.align_tokens(docs, *map(tokenizer_file, FILES)).orderBy("doc_id").collect()
    for r, t in zip(got, TEXTS):
        x, y, links, groups = plain(libraries, t) or ([], [], [], [])
        assert (r.a_ids, r.b_ids, [tuple(k) for k in r.links], r.groups, r.other) == (x, y, links, ";".join(groups), "kept")


def test_given_documents(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = QUERIES["op11_token_alignment"](spark, SF).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in got] == [(d.doc_id, *e) for d, e in zip(docs, expected(libraries, [d.text for d in docs]))]


@pytest.mark.parametrize("texts", [[], [None, ""], TEXTS])
def test_odd_tables(spark, tmp_path, libraries, texts):
    rows = [(None if i % 7 == 0 else i // 2, t, 1, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_a int, block string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_token_alignment"](spark, str(tmp_path)).select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), *COLUMNS).collect()
    want = [(-1 if r[0] is None else r[0], *e) for r, e in zip(rows, expected(libraries, texts))]
    assert sorted(map(tuple, got)) == sorted(want)
