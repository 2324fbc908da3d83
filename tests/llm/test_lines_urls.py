import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tsflow.llm import line_dedup, url_filters
from tsflow.llm.queries import ORACLES, QUERIES
from tsflow.plans.compare import compare, duck

SF = "/root/testdata/sf0.01"
WHITE = " \t\n\x0b\x0c\r"


def brute_lines(rows, least, chars):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(WHITE))
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    docs = Counter(k for _, ls in lines for k in {key(x) for x in ls})
    out = []
    for i, ls in lines:
        kept = [x for x in ls if len(key(x)) < chars or docs[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "Common\nown a\n common\t"), (5, "COMMON \nÄRGER\nown b"), (6, "common"), (6, "common"),
            (None, "ärger\ncommon\r\nÄrger"), (7, "same\nsame\nsame"), (8, "long " * 30000 + "\ncommon"), (9, "\n".join(f"l{i}" for i in range(20000)) + "\ncommon")]
    rows += [(100 + i, "a copy\nl7") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least, chars in ((3, 1), (2, 3), (1, 1)):
        got = line_dedup.digests(df, min_docs=least, min_chars=chars).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows, least, chars)


def test_line_dedup_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "x", "p", 3, 4, 5)], "doc_id long, text string, key string, n int, a int, t1 int")
    assert line_dedup.with_kept(df, "text", 1, 1).columns == ["row", "n_lines", "n_dropped", "kept"]
    assert line_dedup.digests(df).count() == 1
    assert line_dedup.digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op2_url_filters", "op5_line_dedup"])
def test_sql(spark, name):
    ok, msg = compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name])
    assert ok, msg


def test_cascade_is_exact(spark):
    keys = spark.range(4000).selectExpr("concat('k', id) AS key", "id % 7 = 0 OR id < 500 AS listed")
    cascade = url_filters.Cascade(keys)
    assert len(cascade.levels) > 2
    bad = cascade.mark(keys, "key", "got").where("got != listed")
    assert bad.count() == 0
    joined = url_filters.Cascade(keys, max_words=2)
    assert joined.exact is not None and joined.mark(keys, "key", "got").where("got != listed").count() == 0


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://WWW.Example.ORG"), (6, "x://a.org/es/?://b.com/de/"),
            (7, "http://example.org/es/1"), (8, "http://a.example.org/en/19#x"), (9, "http://notexample.org/es/1"), (10, "http://com/fr/x"),
            (11, "http://ads-track.example.com/fr/1"), (12, "http://ads-track.example.com/en/1"), (12, "http://ads-track.example.com/en/1"),
            (None, "http://m.ADULT-X.example.net?q=/"), (13, "http://Ä.ORG/a\nb"), (14, "http://u@" + "x" * 5000 + ".net/" + "y" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS listed", "'z' AS rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df, url_filters.RULES, url_filters.LISTED_LABELS).collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5] == ("www.example.org", "", None, "allow")
    assert got[6] == ("a.org", "/es/", "org/", "allow")
    assert got[7][2:] == ("example.org/es/", "block") and got[8][2:] == ("example.org/en/1", "block")
    assert got[9][2:] == ("org/", "allow") and got[10][2:] == ("com/fr/", "allow")
    assert got[11][2:] == ("com/fr/", "allow") and got[12][2:] == (None, "block")
    assert got[None] == ("m.adult-x.example.net", "", None, "block")
    assert got[13][:2] == ("Ä.org", "/a\nb") and len(got[14][0]) == 5006
    assert url_filters.judge_urls(df.limit(0), url_filters.RULES, url_filters.LISTED_LABELS).count() == 0


CLASHING = ("__gone", "__t1", "__t2", "gone", "t1", "t2", "row", "kept", "n_lines", "n_dropped", "a", "b", "at", "key", "line", "a.b")


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline
    from tsflow.llm import decontamination
    rows = [(i, f"shared line\nown {i}", 1) for i in range(12)] + [(12, "shared line", 1), (13, None, None), (14, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    df = df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    got = corpus_pipeline.lines(spark, df, "")
    assert got.columns == df.columns
    kept = {r.doc_id: r for r in got.collect()}
    assert sorted(kept) == [*range(12), 13, 14]
    assert all(kept[i].text == f"own {i}" and kept[i].n_chars == len(f"own {i}") for i in range(12))
    assert all(r[c] == f"{c}{i}" for i, r in kept.items() for c in CLASHING)
    item = "what is the largest planet that moves around the sun in our system"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = df.union(df.limit(1).withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit(f"They asked: {item}?")}))
    clean = decontamination.drop_leaking(df, benchmark)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == list(range(15))
    assert all(r[c] == f"{c}{r.doc_id}" for r in clean.collect() for c in CLASHING)
