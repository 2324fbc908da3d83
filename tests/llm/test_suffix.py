import hashlib
import random
from collections import Counter

import duckdb
import pytest

from tsflow.llm import suffix_dedup as S
from tsflow.llm.queries import QUERIES


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\x01" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def near_rows(seed, n, size):
    r = random.Random(seed)
    word = lambda: r.choice("the of and rein über tion erst la señor que".split()) + r.choice("abcdefgh") * r.randint(0, 3)
    base = [[word() for _ in range(r.randint(size, 4 * size))] for _ in range(8)]
    rows = []
    for i in range(n):
        kind = r.randint(0, 5)
        w = list(r.choice(base))
        if kind == 0:
            w = [word() for _ in range(r.randint(1, size))]
        elif kind == 1:
            w = w[r.randint(0, len(w) // 2):] + [word() for _ in range(20)]
        elif kind == 2:
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = word() + "x"
        elif kind == 3:
            w = w + w[:len(w) // 2]
        elif kind == 4:
            w.insert(r.randrange(len(w)), word() * r.randint(1, 3))
        rows.append((i, " ".join(w)))
    return rows


EDGES = [(900, None), (901, ""), (902, "x" * 5000), (903, "ab" * 400), (904, "short"), (905, "q" * 399), (906, "y" * 400), (907, "z" * 401),
         (None, "null id " + "abc " * 300), (908, "same row " * 60), (908, "same row " * 60), (909, "ü" * 300)]


@pytest.mark.parametrize(("length", "options"), [(400, {}), (400, {"block": 16, "group": 2}), (60, {}), (137, {"block": 1})])
def test_matches_brute_force(spark, length, options):
    rows = near_rows(length, 120, max(12, length // 4)) + EDGES
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS gram", "2 AS t1", "'x' AS kept").repartition(5)
    got = sorted(map(tuple, S.drop_repeats(df, length=length, **options).collect()), key=str)
    want = brute(rows, length)
    assert got == want and sum(w[2] for w in want) > 0


def test_empty(spark):
    assert S.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert S.drop_repeats(spark.createDataFrame([(1, None), (2, "a")], "doc_id long, text string")).where("n_removed = 0").count() == 2


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = sorted(map(tuple, QUERIES["op10_suffix_dedup"](spark, sf).collect()), key=str)
    assert got == brute(rows, 400)
