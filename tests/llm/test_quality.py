"""Quality scores: held-out accuracy, the folds, and odd tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from sluice.llm import quality
from sluice.llm.queries import QUERIES
from sluice.llm.text import parts
from texts import odd_texts

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("score", T.StringType())])
LABELS = "doc_id long, quality int, toxic int, text string"


def area(y, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality"](spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    known = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    unseen = known[known.held_out]
    assert area(unseen.quality.to_numpy(), unseen.score.to_numpy()) > 0.95
    assert (unseen.predicted == unseen.quality).mean() > 0.95


def test_held_out_labels_are_never_read(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert not other.exceptAll(labels).isEmpty()
    a, b = quality.fit_quality(docs, labels), quality.fit_quality(docs, other)
    assert a.start == b.start and (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()
    swapped = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    c = quality.fit_quality(swapped, labels)
    assert (a.leaf == c.leaf).all()


def test_flat_trees_equal_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.boost(x, y, trees=15, depth=3)
    for row, score in zip(x[:60], trees.score(x[:60])):
        total = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("part", [7, 100, 5000])
def test_long_texts_in_parts(monkeypatch, part):
    """Every statistic is the same however a text is cut, also for sections that are repeated."""
    section = " ".join(f"word{i % 70}{'.' * (i % 9 == 0)}{chr(10) * (i % 11 == 0)}" for i in range(900))
    for text in [(section + "\n") * 3, "again again " * 3000, *odd_texts(60), "A b\n" * 500, "x" * 400]:
        whole = quality.statistics(text)
        with monkeypatch.context() as m:
            m.setattr(quality, "PART", part)
            m.setattr(quality, "parts", lambda t: parts(t, part))
            np.testing.assert_allclose(quality.statistics(text), whole, rtol=1e-9, atol=1e-12)


def test_statistics_are_finite():
    for t in odd_texts(400):
        got = quality.statistics(t)
        assert len(got) == len(quality.STATISTICS) and np.isfinite(got).all(), repr(t)


@pytest.mark.parametrize("labels", [[], [(1, None, 0, "x")], [(1, 1, 0, "x")] * 30, [(None, 1, 0, "x"), (99, 0, 0, "y")],
                                    [(i, i % 2, 0, "x") for i in range(60)] + [(i, 1, 0, "x") for i in range(9)]])
def test_odd_tables(spark, tmp_path, labels):
    rows = [(i if i % 9 else None, t, "en", "s", "old") for i, t in enumerate([None, *odd_texts(60)])] + [(4, "again", "en", "s", "old")] * 2
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for given in (rows, []):
        spark.createDataFrame(given, DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = QUERIES["op4_quality"](spark, str(tmp_path)).toPandas()
        assert len(got) == len(given) and got.score.between(0, 1).all() and not got.held_out.isna().any()
    if not labels:
        assert (quality.Trees(0.0, *(np.zeros((0, n)) for n in (31, 31, 32))).score(np.zeros((3, 2))) == 0.5).all()
