import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tsflow.llm import license_scan as L
from tsflow.llm.license_texts import TEMPLATES
from tsflow.llm.queries import QUERIES


def plain_align(t, d):
    """Unbanded local alignment with the same scores: words matched."""
    best = (0, 0)
    row = [(0, 0)] * (len(d) + 1)
    for w in t:
        new = [(0, 0)]
        for j, x in enumerate(d):
            if x == w:
                s = (row[j][0] + 1, row[j][1] + 1)
            else:
                m = max(row[j], row[j + 1], new[j])
                s = (m[0] - 1, m[1]) if m[0] > 1 else (0, 0)
            new.append(s)
            best = max(best, s)
        row = new
    return best[1]


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\xff]+", (text or "").encode().decode("latin-1").lower().translate({i: chr(i) for i in range(128)}))


def rows():
    mit = TEMPLATES["mit"]
    edited = mit.replace("without restriction,", "without any limits or restriction").replace("merge, ", "").replace("HOLDERS", "OWNERS")
    out = [(1, None), (2, ""), (3, "nothing to see"), (4, "intro\n" + mit + "\noutro"), (5, "// " + edited.replace(" ", "\n * ")), (6, "é " * 20 + "Released under the MIT license"),
           (7, TEMPLATES["mit-notice"] + " filler text here " * 9 + TEMPLATES["mit-notice"].upper()), (8, "released under the terms of something"),
           (8, TEMPLATES["unlicense"]), (None, TEMPLATES["isc"]), (9, "word " * 400000 + TEMPLATES["gpl-3.0-header"]), (10, mit[:len(mit) // 2])]
    return out


def test_spans_and_coverage(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").withColumns({"license": F.lit(1), "n_words": F.lit("x")}).repartition(3)
    got = L.scan(df, TEMPLATES).collect()
    seen = {(r.doc_id, r.license) for r in got}
    assert seen == {(4, "mit"), (5, "mit"), (6, "mit-notice"), (7, "mit-notice"), (8, "unlicense"), (None, "isc"), (9, "gpl-3.0-header")}
    assert sum(r.doc_id == 7 for r in got) == 2
    texts = dict(rows()) | {8: TEMPLATES["unlicense"]}
    for r in got:
        span = texts[r.doc_id].encode()[r.begin:r.end]
        assert r.n_matched == plain_align(tokens(TEMPLATES[r.license]), tokens(span.decode())) and abs(r.coverage - r.n_matched / r.n_words) < 1e-12
    exact = next(r for r in got if r.doc_id == 4)
    assert exact.coverage == 1 and texts[4].encode()[exact.begin:exact.end].decode() == TEMPLATES["mit"].rstrip(".")
    assert L.scan(df.limit(0), TEMPLATES).count() == 0


def test_index_is_winnowed():
    index = L.Index.build(TEMPLATES)
    assert len(index.hashes) < sum(map(len, index.words)) / 1.5
    for t, h in enumerate(index.words):  # every window of grams keeps one
        places = set(index.place[index.template == t].tolist())
        n = len(h) - L.GRAM + 1
        assert all(places & set(range(i, i + L.WINDOW)) for i in range(max(1, n - L.WINDOW + 1)))
    assert len(np.unique(np.concatenate(index.words))) > 100


def test_query_finds_what_a_full_alignment_finds(spark):
    sf = "/root/testdata/sf0.001"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {(r.doc_id, r.license): r.n_matched for r in QUERIES["op4_license_scan"](spark, sf).collect()}
    short = {k: tokens(v) for k, v in TEMPLATES.items() if len(v) < 120}
    want = {}
    for i, t in docs:
        ws = tokens(t)
        for name, tpl in short.items():
            if len(ws) < 5000 and (n := plain_align(tpl, ws)) >= .8 * len(tpl):
                want[i, name] = n
    assert {k: v for k, v in got.items() if k[1] in short} == want and want
