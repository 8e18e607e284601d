"""Fill-in-middle: places against Python's own, forms against a plain way and DuckDB."""

import hashlib

import numpy as np
import pytest

from compare import connect, differences
from sluice.llm import infill
from sluice.llm.queries import QUERIES, SQL
from texts import odd_texts

SF = "/root/testdata/sf0.001"


def plain(name, text, share=90, spm_share=20):
    digest = hashlib.sha256(f"1:{'' if name is None else name}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    text = text or ""
    n = len(text)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_share:
        return n, "spm", i, j - i, f"<S>{text[j:]}<P>{text[:i]}<M>{text[i:j]}"
    return n, "psm", i, j - i, f"<P>{text[:i]}<S>{text[j:]}<M>{text[i:j]}"


def test_ends_of_code_points():
    for text in ["", "a", "é", "🙂", *odd_texts(200)]:
        data = np.frombuffer(text.encode(), np.uint8)
        ends = infill.Ends(data)
        places = [len(text[:k].encode()) for k in range(len(text) + 1)]
        assert ends.place(np.arange(len(text) + 1)).tolist() == places
        inside = np.arange(len(data) + 1)
        assert ends.rank(inside).tolist() == np.searchsorted(places[1:], inside, side="right").tolist()


ROWS = [(i, t) for i, t in enumerate([*odd_texts(400), "<P>", "a<S>b", "x<M>", "<P", "S>", "<<P>", "<S", "a<", ">b", "é" * 300_000])]
ROWS += [(None, "no key"), (None, None), (-5, ""), (7, "again again"), (7, "again again")]


@pytest.mark.parametrize("share, spm_share", [(90, 20), (100, 0), (100, 100), (0, 20)])
def test_forms_equal_plain_way(spark, share, spm_share):
    extra = [(k, t, "old", "old", "old") for k, t in ROWS]
    docs = spark.createDataFrame(extra, "doc_id long, text string, form string, output string, text_made string")
    turned = infill.fill_in_middle(docs, share, spm_share)
    assert set(turned.columns) == {*docs.columns, "n", "prefix_chars", "middle_chars"}
    got = turned.withColumn("back", infill.restored(turned["output"], turned["form"])).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    want = sorted(((k, t, *plain(k, t, share, spm_share)) for k, t in ROWS), key=key)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == want
    assert all(r.back == (r.text or "") and r.text_made == "old" for r in got)


@pytest.mark.parametrize("rows", [[], ROWS])
def test_query_equals_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    spark.read.parquet(f"{tmp_path}/documents").toPandas().astype({"doc_id": "Int64"}).to_parquet(f"{tmp_path}/documents.parquet")
    assert differences(spark, QUERIES["op13_fill_in_middle"], SQL["op13_fill_in_middle"], str(tmp_path), connect(str(tmp_path))) is None


def test_given_documents(spark):
    assert differences(spark, QUERIES["op13_fill_in_middle"], SQL["op13_fill_in_middle"], SF) is None
