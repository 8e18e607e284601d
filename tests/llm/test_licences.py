"""License scans against DuckDB and on licence texts as files carry them."""

import duckdb
from pyspark.sql import types as T

from sluice.llm import licences
from texts import odd_texts

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("licences", T.StringType()), T.StructField("n_rules", T.StringType())])
OF = {}
for _name, _text in licences.SENTENCES:
    OF.setdefault(_name, _text)


def wrap(text, width=60):
    out, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


MIT = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + "\n\n".join([wrap(OF["mit-grant-head"]), wrap(OF["mit-keep"] + "."), wrap(OF["mit-warranty"] + ". " + OF["mit-liability"] + ".")])
APACHE = wrap(OF["apache-notice-long"] + ".") + "\n" + OF["apache-copy"].rsplit(" ", 1)[0] + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\n" + wrap(OF["apache-basis"] + ".")
BSD = "\n\n".join([wrap(OF["bsd-head"]), "1. " + OF["bsd-source"] + ".", "2. " + OF["bsd-binary"] + ".", "3. " + OF["bsd-names"] + "."])
CASES = [
    ("some text\nReleased under the MIT License.\nmore text", "MIT", 1, 1),
    ("RELEASED   under the\tmit license!", "MIT", 1, 1),
    ("not released under the MIT License.", "", 0, 0),
    ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", "Apache-2.0,MIT", 2, 2),
    ("Released under the MIT License. x\n" * 3, "MIT", 3, 3),
    (MIT, "MIT", 1, 5),
    (APACHE, "Apache-2.0", 1, 3),
    (OF["bsd-source"] + ". " + OF["bsd-binary"] + ".", "BSD-2-Clause", 1, 2),
    (OF["bsd-binary"] + ". " + OF["bsd-source"] + ".", "", 0, 2),
    (BSD, "BSD-3-Clause", 1, 4),
    (OF["bsd-source"] + ". " + "other. " * licences.GAP + OF["bsd-binary"] + ".", "BSD-2-Clause", 1, 2),
    (OF["bsd-source"] + ". " + "other. " * (licences.GAP + 1) + OF["bsd-binary"] + ".", "", 0, 2),
    ("word " * 50000 + "\n" + wrap(OF["mpl-notice"], 30) + ". 2.0.", "", 0, 0),
    ("word " * 50000 + "\n\n" + wrap(OF["mpl-notice"], 30) + ". 2.0.\n\nx", "MPL-2.0", 1, 1),
    ("Released under the MIT License\nLicensed under the MIT License\nMIT License\nLicensed under MIT License\n\n" + wrap(OF["bsd-source"] + ". " + OF["bsd-binary"] + "."),
     "BSD-2-Clause,MIT", 5, 6),
    ("SPDX-License-Identifier: MIT", "MIT", 1, 1), ("Licensed under the Mozilla Public License, version 2.0.", "MPL-2.0", 1, 1),
    ("Distributed under the BSD 3-Clause License.", "BSD-3-Clause", 1, 1), ("Licensed under GPLv3.", "GPL-3.0-only", 1, 1),
    ("# SPDX-License-Identifier: Apache-2.0\n\nx", "Apache-2.0", 1, 1), ("Boost Software License, Version 1.0", "BSL-1.0", 1, 1),
    ("Eclipse Public License - v 2.0", "EPL-2.0", 1, 1), ("  GNU GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007\n\n other", "GPL-3.0-only", 1, 2),
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0", 1, 2),
    (wrap(OF["zlib-warranty"] + ". x y. " + OF["zlib-grant"]), "Zlib", 1, 2),
    (None, "", 0, 0), ("", "", 0, 0), (" . ! \n\n", "", 0, 0),
]


def test_cases(spark):
    docs = spark.createDataFrame([(k, c[0], "old", "old") for k, c in enumerate(CASES)], DOCS)
    got = {r.doc_id: (r.licences, r.n_rules, r.n_sentences) for r in licences.scan_licences(docs).collect()}
    for k, (text, *want) in enumerate(CASES):
        assert got[k] == tuple(want), (text or "")[:200]


def test_equals_duckdb(spark, tmp_path):
    sentences = [t for _, t in licences.SENTENCES] + [t for _, t in licences.notices()][::7]
    texts = [c[0] for c in CASES] + odd_texts(60) + [a + end + b for a, b in zip(sentences, sentences[1:]) for end in (". ", "\n", "\n\n", ".\n", "! x. y? ")] + [BSD]
    docs = spark.createDataFrame([(i if i % 13 else None, t, "old", "old") for i, t in enumerate(texts)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(licences.oracle_sql()).fetchall(), key=str)
    got = licences.scan_licences(docs).select("doc_id", "licences", "n_rules", "n_sentences")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert licences.scan_licences(docs.limit(0)).count() == 0


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "x", "", "")], DOCS)
    plan = licences.scan_licences(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("EvalPython", "InPandas", "InArrow", "Exchange", "Generate "))


def test_every_sentence_has_one_meaning():
    met = {}
    for name, text in licences.sentences():
        assert met.setdefault(licences.normal(text), name) == name or (name, text) in licences.SENTENCES, text
    assert len(licences.NAMES) >= 40 and len({n for n, _ in licences.RULES}) >= 45
    assert len(licences.codes()) < 1000
