"""HTML extraction: parsing, gradients of the labeller, and extraction against known main text."""

import html

import numpy as np
import pytest
from pyspark.sql import types as T

from sluice.llm import pages
from sluice.llm.queries import QUERIES
from texts import odd_texts

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                      T.StructField("text", T.StringType()), T.StructField("n_chars", T.StringType())])
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return pages.fit_labeller(spark.read.parquet(f"{SF}/pages.parquet"))


def texts(page):
    return [leaf.text for leaf in pages.leaves(page)]


def test_leaves():
    assert texts("<p>a &amp; b&nbsp;c<p>d<br>e</p>f") == ["a & b c", "d", "e", "f"]
    assert texts('<script>var t="</p><p>no";</script><style>p{}</style><!-- <p>no</p> --><p title="a>b">x <b>y</b>z</p>') == ["x yz"]
    assert texts("<ul><li>a<li>b <a href='#'>c</a></ul><table><tr><td>1<td>2</table>") == ["a", "b c", "1", "2"]
    assert texts("a < b &lt;p&gt; <3 &bogus; &#x41;") == ["a < b <p> <3 &bogus; A"]
    assert texts("") == texts("<p></p>") == texts("<script>never ends <p>x") == texts("<!-- never ends <p>x") == []
    assert texts("<p title=\"never ends>x") == ["x"]
    assert texts("<SCRIPT>a</script ><P>b</P>") == ["b"]
    leaf = pages.leaves('<main class="Post-Body x" id=top><p><a href="/">link</a> tail</p></main>')[0]
    assert leaf.path == ("main", ".post", ".body", ".x", ".top", "p") and 0.3 < leaf.linked < 0.6


def test_unclosed_inline_does_not_leak_blocks():
    found = pages.leaves("<article><p><b>one<br><p>two</p></article><footer>three</footer>")
    assert [(x.text, x.path) for x in found] == [("one", ("article", "p")), ("two", ("article", "p")), ("three", ("footer",))]


def test_drawings_and_templates():
    assert texts("<article><svg/><p>x</p></article>") == ["x"]
    assert texts("<p>a<svg viewBox='0 0 1 1'><title>t</title><style/><path d='M0'/><text>no</text></svg>b</p><p>c") == ["ab", "c"]
    assert texts("<svg><svg><text>no</text></svg><text>no</text></svg><p>x") == ["x"]
    assert texts("<template><div>no<template>no</template>no<p>no</div></template><p>x") == ["x"]
    assert texts("<p>a<noscript><img src=i><div>no</div></noscript>b") == ["ab"]
    assert texts("<svg><foreignObject><p>no</p></foreignObject></svg><p>x") == ["x"]
    for name in ("svg", "template", "noscript"):
        assert texts(f"<div>a<{name}><g>no</div><p>x") == ["a", "x"]
    assert texts("<article><svg><path><p>x</p></article><p>y") == ["x", "y"]
    leaf = pages.leaves("<main>a<template><div class=c>no</main>")[0]
    assert (leaf.text, leaf.path) == ("a", ("main",))


def test_parsing_never_fails_and_is_linear():
    for t in odd_texts(100):
        pages.leaves(t)
        pages.leaves(f"<div {t}<p>{t}</p")
        assert texts(f"<p>{html.escape(t)}</p>") == ([" ".join(t.split())] if t.split() else [])
    for bad in ("<" * 20000, "<a " * 5000, '<a b="' * 3000, "<p>" * 5000, "<div>" * 3000 + "x", "&" * 20000, "<!--" * 5000):
        pages.leaves(bad)


def test_gradients():
    rng = np.random.default_rng(0)
    model = pages.Labeller.new(3, rng)
    x, live = pages.padded([rng.standard_normal((n, pages.WIDTH)) for n in (4, 1, 6)], np.float64)
    y = (rng.random(live.shape) < 0.5) * 1.0
    loss, grads = model.gradients(x, live, y)
    for w, g in zip(model.w, grads):
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in w.shape)
            old = w[at]
            w[at] = old + 1e-5
            up = model.gradients(x, live, y)[0]
            w[at] = old - 1e-5
            down = model.gradients(x, live, y)[0]
            w[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_padding_changes_nothing(model):
    rng = np.random.default_rng(1)
    rows = [rng.standard_normal((n, pages.WIDTH)).astype(np.float32) for n in (2, 9, 30)]
    x, live = pages.padded(rows)
    together = model.chances(x, live)
    for k, r in enumerate(rows):
        alone = model.chances(*pages.padded([r]))[:, 0]
        assert np.allclose(alone, together[:len(r), k], atol=1e-5)


def test_registered_extracts_the_article(spark):
    given = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    got = QUERIES["op8_main_text"](spark, SF).toPandas().set_index("page_id")
    assert len(got) == len(given)
    want = [" ".join(x.text for x in pages.leaves(h) if "article" in x.path) for h in given.html]
    right = [got.text[i] == w for i, w in zip(given.page_id, want)]
    assert np.mean(right) >= 0.99
    assert all(got.n_chars[i] == len(got.text[i]) for i in given.page_id)


def test_other_layouts(spark, model):
    """Pages of layouts that no training page had a copy of: blocks are labelled as made, nearly always."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(150).toPandas()
    made = pages.Layouts([" ".join(x.text for x in pages.leaves(h) if "article" in x.path) for h in given.html], seed=99)
    wrong = n = 0
    for h in given.html:
        body = [x.text for x in pages.leaves(h) if "article" in x.path and "h1" not in x.path]
        blocks, labels = pages.labelled(made.page(body[:30]))
        main = model.chances(*pages.padded([pages.features(blocks)]))[:, 0] >= 0.5
        wrong += int((main != labels).sum())
        n += len(labels)
    assert wrong / n < 0.02


def test_odd_tables(spark, tmp_path):
    rows = [(i, None, h, "old", "old") for i, h in enumerate([None, "", "<p>", "plain text only", *odd_texts(20), "<article><p>x</p></article>" * 2000])] + [(None, "u", "<p>a</p>", "", "")] * 2
    for given in ([], rows):
        spark.createDataFrame(given, PAGES).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
        got = QUERIES["op8_main_text"](spark, str(tmp_path)).toPandas()
        assert got.columns.tolist() == ["page_id", "url", "text", "n_chars"] and len(got) == len(given)
        assert all(len(t) == n for t, n in zip(got.text, got.n_chars))
