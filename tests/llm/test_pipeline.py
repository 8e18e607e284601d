"""The pipeline: stages work on all that the one before kept, and its rows equal those of plain Python."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import mixing, quality
from sluice.llm.queries import tokenizer_file
from test_near_copies import plain_kept

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_rows(spark):
    from sentencepiece import SentencePieceProcessor

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near copies", "source mix", "sentencepiece"]
    trees = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r for r in docs.collect()}
    scores = trees.score(quality.matrix([r.text or "" for r in texts.values()]))
    good = {i: r for (i, r), s in zip(texts.items(), scores) if s >= 0.5}
    kept = plain_kept([(i, r.text) for i, r in good.items()])
    assert 0 < len(kept) < len(good) < len(texts)

    first = stage["quality"](spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == set(good)
    second = stage["near copies"](spark, first, SF)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == kept
    third = stage["source mix"](spark, second, SF)
    assert third.columns == docs.columns
    drawn = {r.doc_id: r.n for r in mixing.draw(second).select("doc_id", F.size("draws").alias("n")).collect()}
    assert set(drawn) == kept and max(drawn.values()) <= 3
    times = Counter({i: n for i, n in drawn.items() if n})
    assert Counter(r.doc_id for r in third.collect()) == times

    sp = SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = Counter()
    for i, n in times.items():
        ids = sp.encode(texts[i].text or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(i, texts[i].source, len(ids), digest(",".join(map(str, ids))), digest(sp.decode(ids)))] = n
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_clashing_columns_pass_unchanged(spark):
    """Extra columns named like what the stages add keep their values."""
    extra = ["score", "size", "target", "draws", "draw", "fp", "root", "component_id", "n_tokens", "source_size", "blocks", "key"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("*", *[F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[5:] == extra, name
        docs = docs.cache()
        assert docs.count() and docs.where(" and ".join(f"{c} = concat('{c} ', doc_id)" for c in extra)).count() == docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "one text only", "en", None, 3), (1, "one text only", "en", None, 3), (2, "", "en", "s", 0)]])
def test_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows}
    assert len(got) == (1 if len(rows) == 3 and rows[0][0] else 0)
