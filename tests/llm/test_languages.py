"""Language identification: sums over all segmentations against listing them, and held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sluice.llm import languages
from sluice.llm.queries import QUERIES, tokenizer_file
from texts import odd_texts

FILE = "piece_bpe_32k.model"
ODD = ["the", "a", "straße", "öach", "naïve", "русский", "中文字", "ﬁx", "ꙮꙮx", "𝔘", "i̇", "x" * 20]


@pytest.fixture(scope="module")
def vocabulary():
    return languages._vocabulary(tokenizer_file(FILE))


@pytest.fixture(scope="module")
def p(vocabulary):
    rng = np.random.default_rng(3)
    p = vocabulary.start[:, None] * rng.uniform(0.5, 2, (vocabulary.size, 3))
    return p / p.sum(axis=0)


def ways(vocabulary, word):
    """All lists of pieces that write ``word``; a character without a piece is written in bytes."""
    if not word:
        return [[]]
    if word[0] not in vocabulary.ids:
        head = [vocabulary.of_byte[b] for b in word[0].encode()]
        return [head + rest for rest in ways(vocabulary, word[1:])]
    return [[vocabulary.ids[word[:k]], *rest] for k in range(1, len(word) + 1) if word[:k] in vocabulary.ids for rest in ways(vocabulary, word[k:])]


def test_sums_over_all_segmentations(vocabulary, p):
    words = [w for w in ODD if len(w) < 10]
    got = languages.log_probabilities(words, vocabulary, p)
    times = np.arange(1, len(words) * 3 + 1).reshape(-1, 3)
    want = np.zeros(p.shape)
    for w, row, n in zip(words, got, times):
        cuts = ways(vocabulary, "▁" + w)
        chances = np.array([p[c].prod(axis=0) for c in cuts])
        np.testing.assert_allclose(row, np.log(chances.sum(axis=0)), rtol=1e-9)
        for cut, share in zip(cuts, chances / chances.sum(axis=0)):
            for piece in cut:
                want[piece] += share * n
    np.testing.assert_allclose(languages.expected_counts(words, times, vocabulary, p), want, rtol=1e-8, atol=1e-12)


def test_long_words_stay_finite(vocabulary, p):
    words = [c * languages.LONGEST for c in "aꙮ中ж𝔘ß"] + ["the" * 16, "a" + "𝔘" * 47]
    assert np.isfinite(languages.log_probabilities(words, vocabulary, p)).all()
    alone = np.array([languages.log_probabilities([w], vocabulary, p)[0] for w in words])
    np.testing.assert_allclose(languages.log_probabilities(words, vocabulary, p), alone, rtol=1e-12)


def test_words_of_texts():
    assert languages.letter_words("Ab1c_d'É " + "x" * 100) == ["ab", "c", "d", "é", "x" * 48, "x" * 48, "xxxx"]
    long = "word and more " * 200_000
    assert languages.word_counts(long) == Counter(languages.letter_words(long))
    assert not languages.has_letter("12 -_ ²\n") and languages.has_letter("1 中")


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_language"](spark, sf).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(docs))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held) > 200


def test_counts_of_all_rows_and_no_held_out_one(spark, vocabulary):
    """The learned probabilities are those of plain sums over the rows that may be seen."""
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(odd_texts(60))] + [(None, "null keys learn", "a"), (5, None, "b"), (6, "no language", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = languages.fit_languages(docs, tokenizer_file(FILE))
    seen = [r for r in rows if r[2] and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 4 != 2)]
    assert model.languages == ["a", "b"] and math.isclose(model.prior[0], sum(r[2] == "a" for r in seen) / len(seen))
    counts = np.zeros((vocabulary.size, 2))
    for _, text, lang in seen:
        words = languages.letter_words(text or "")
        counts[:, "ab".index(lang)] += languages.expected_counts(words, np.ones((len(words), 1)), vocabulary, vocabulary.start[:, None])[:, 0]
    want = 0.98 * counts / counts.sum(axis=0) + 0.02 * vocabulary.start[:, None]
    np.testing.assert_allclose(model.p, want, atol=1e-4)


@pytest.mark.parametrize("rows", [[], [(1, None, None, 1), (2, "", "en", 1), (3, "12 3", None, 1)],
                                  [(4, "le chat et le chien", "fr", 1), (4, "le chat et le chien", "fr", 1), (None, "the cat and the dog", "en", 1), (8, "the dog", None, 1),
                                   (9, "中文" * 300_000, "en", 1), (10, None, "fr", 1), (11, "...", "fr", 1)]])
def test_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_language"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    told = {r.doc_id: r.lang_pred for r in got}
    und = {r[0] for r in rows if not languages.has_letter(r[1] or "")}
    assert {i for i, n in told.items() if n == "und"} == und
    assert len(rows) < 7 or told[4] == "fr" and told[8] == "en"


def test_more_rounds_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, n, "old", "kept") for i in range(8) for t, n in (("the old house of the man", "en"), ("la casa del hombre viejo", "es"))],
                                 "doc_id long, text string, lang string, lang_pred string, other string")
    model = languages.fit_languages(docs, tokenizer_file(FILE), rounds=3)
    got = languages.predict_languages(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "other", "score"]
    assert all(r.lang == r.lang_pred and r.other == "kept" for r in got.collect())


def test_all_pieces_are_found_at_all_places():
    pieces = {p: i for i, p in enumerate(["a", "ab", "abc", "bc", "b", "▁a", "▁", "ét", "日本", "bcab"])}
    text = "▁abcabc\n▁été x日本日\U0001f600\x00ab\n"
    ends, ids = languages.Trie(pieces).find(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    expected = {(at + len(p) - 1, i) for p, i in pieces.items() for at in range(len(text)) if text.startswith(p, at)}
    assert len(ends) == len(expected) and set(zip(ends.tolist(), ids.tolist())) == expected


def test_words_of_texts_with_and_without_far_characters():
    for text in ("naïve ²³ ªº ĳ x_1 ǅʰ", "İstanbul é́t a͏b ﬁ", "ру́с 日本 a1b"):
        assert languages.letter_words(text) == languages._letters.findall(text.lower())
