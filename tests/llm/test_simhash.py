import random

import numpy as np
import xxhash

from tsflow.llm import simhash_dedup as S
from tsflow.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


def brute_fp(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in WHITE:
            words, cur = words + [cur] * bool(cur), ""
        else:
            cur += c
    if not words:
        return 0
    sh = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: [(id, fp)] -> root by smallest id."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(fps)]


def test_anchor_code():
    over, p, begin = S.patterns(0)
    assert len(p) == 2048 and (np.diff(begin) == 1).all()          # perfect: one codeword within radius 3
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 3), replace=False)) for _ in a], np.uint64)
    i, anchor, home = S.anchors(a, 2)
    j, other, _ = S.anchors(a ^ flips, 2)
    reach = set(zip(j.tolist(), other.tolist(), strict=True))
    assert home.sum() == len(a) and len(i) < 75 * len(a)
    assert all(x in reach for x in zip(i[home].tolist(), anchor[home].tolist(), strict=True))


def near_rows(n):
    r = random.Random(9)
    rows = []
    for i in range(n):
        words = [r.choice("alpha beta gamma delta Épsilon zeta eta theta".split()) + str(r.randint(0, 300)) for _ in range(r.randint(30, 60))]
        rows.append(" ".join(words))
        for _ in range(r.randint(0, 4)):
            w = list(words)
            w[r.randrange(len(w))] = "x"
            rows.append("\t".join(w).upper() if r.random() < .2 else " \n".join(w))
    return rows


def test_groups_match_brute_force(spark):
    texts = near_rows(60) + [None, "", " \n", "one", "one two", "ONE two", "a b c", "same again here now"] * 2 + ["long words " * 40000]
    rows = [(500 - i if i % 7 else i, t) for i, t in enumerate(texts)] + [(None, "one"), (None, "lonely null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = S.simhash_groups(df).collect()
    want = brute_components([(d, brute_fp(t)) for d, t in rows])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = S.keep_one(df.selectExpr("*", "1 AS fp", "2 AS __fp", "'k' AS c0")).collect()
    assert len(kept) == len({w[2] if w[2] is not None else ("null", w[1]) for w in want})
    assert {r.doc_id for r in kept if r.doc_id is not None} == {w[2] for w in want if w[2] is not None}


def test_chain_of_links(spark):
    """Each fingerprint is one bit from the next: one component through many steps."""
    fps = [0]
    for b in range(60):
        fps.append(fps[-1] | 1 << b)
    edges = S.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert edges.count() == 60 + 59
    assert S.components(edges).select("root").distinct().count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, component_id long")
    assert S.simhash_groups(df).count() == 0 and S.keep_one(df).count() == 0


def test_query_small_table(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, QUERIES["op7_simhash_dedup"](spark, sf).collect()), key=key) == sorted(
        brute_components([(d, brute_fp(t)) for d, t in rows]), key=key)
