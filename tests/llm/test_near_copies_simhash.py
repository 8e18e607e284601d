"""The near-copy stage takes op2's SimHash groups, and whole shingle sets decide about them."""

import corpus_pipeline
from sluice.llm import minhash, simhash
from test_near_copies import plain_kept


def test_stage_runs_simhash_and_checks_its_groups(spark, monkeypatch):
    long = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-1])), (3, " ".join(long[:-1])), (4, "a b c d e f g"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    calls, plain = [], simhash.near_groups

    def lump(given):
        calls.append(1)
        return plain(given).drop("root").selectExpr("*", "0L as root")  # one group of all texts: the check must part them

    monkeypatch.setattr(simhash, "near_groups", lump)
    assert {r.doc_id for r in corpus_pipeline.near_copy_stage(spark, docs, "").collect()} == plain_kept(rows) == {1, 4, 5}
    assert calls


def test_simhash_links_count_without_bands(spark, monkeypatch):
    long = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:-1]))], "doc_id long, text string")
    monkeypatch.setattr(minhash, "star_pairs", lambda met: met.selectExpr("node as a", "node as b").where("false"))
    monkeypatch.setattr(minhash, "prefix_pairs", lambda nodes, sets, similarity: nodes.selectExpr("node as a", "node as b").where("false"))
    assert [r.doc_id for r in minhash.keep_one(docs, proposed=docs.selectExpr("xxhash64(text) as text_hash", "1L as root")).collect()] == [1]


def test_all_of_a_group_meet_though_no_band_does(spark, monkeypatch):
    """Near copies of one another in a group whose commonest text is like none of them."""
    long = [[f"{c}{i}" for i in range(200)] for c in "xyz"]
    texts = [" ".join(long[0])] * 3 + [" ".join(w[:k]) for w in long[1:] for k in (200, 199, 198)] + [None, ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = minhash.with_bands
    monkeypatch.setattr(minhash, "with_bands", lambda docs, shingle: plain(docs, shingle).selectExpr("doc_id", "text_hash", "node", "cast(array() as array<bigint>) as bands"))
    one = docs.selectExpr("xxhash64(coalesce(text, '')) as text_hash", "1L as root")
    assert {r.doc_id for r in minhash.keep_one(docs, proposed=one).collect()} == plain_kept(rows) == {0, 3, 6, 9}
