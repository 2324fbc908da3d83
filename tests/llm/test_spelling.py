import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tsflow.llm import spelling as S
from tsflow.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"


def brute_words(rows, every=97, min_chars=5, min_count=3):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in {next((k for k in range(len(a)) if a[k] != b[k]), len(a))})


def brute(rows, **kw):
    n = brute_words(rows, **kw)
    holes = {}
    for w in n:  # words one edit apart share the word or one with a letter taken out
        if len(w) > 30:
            continue
        for v in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            holes.setdefault(v, set()).add(w)
    near = {w: {v for v in n if abs(len(v) - len(w)) < 2 and len(v) > 29 and one_edit(w, v)} if len(w) > 29 else
            {v for h in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))} for v in holes[h] if one_edit(w, v)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, n[w], len(near[w]), form[w] or "", n.get(form[w], 0), root(w)) for w in n)


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


def test_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert got(QUERIES["op13_spelling_variants"](spark, SF001)) == brute(rows)


def test_dense_vocabulary_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "HELD", 50)
    rng = random.Random(1)
    letters = "ab×ÿ"
    rows = [(i, " ".join("".join(rng.choices(letters, k=rng.randint(4, 7))) for _ in range(300)) + " ABABA ababa aBaba") for i in range(60)]
    rows += [(i, " ".join("ab" * k + c for k in (3, 4) for c in letters)) for i in range(7)] + [(None, "null id word word")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert len(want) > 500 and got(S.spelling_variants(df)) == want


def test_long_chains(spark):
    rows = [(0, " ".join(["abcdefghij"[:5] + "k" * j] * 3 * 2 ** j)[:]) for j in range(9)]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    result = got(S.spelling_variants(df, every=10 ** 12))
    assert result == brute(rows, every=10 ** 12)
    assert {r[5] for r in result} == {"abcde" + "k" * 8}


def keys(of, word):
    return [int(k) for part in of(S._letters([word])) for k in part[0] if k]


@pytest.mark.parametrize("places", [3, S.PLACES])
def test_neighbourhood_is_complete(monkeypatch, places):
    monkeypatch.setattr(S, "PLACES", places)
    rng = random.Random(2)
    for _ in range(2000):
        w = "".join(rng.choices("abcdeé", k=rng.randint(5, 8)))
        at = rng.randrange(len(w) + 1)
        v = w[:at] + rng.choice(["", *"abcdeé"]) + w[at + rng.randint(0, 1):]
        if len(v) >= 5 and one_edit(w, v):
            assert set(keys(S.neighbourhood, w)) & set(keys(S.listed, v))


def test_neighbourhood_is_no_larger_than_needed():
    rng = random.Random(3)
    symbols = range(1, S.SYMBOLS + 1)
    for _ in range(300):
        w = "".join(rng.choices("abcdeéxyz", k=rng.randint(5, 9)))
        r = [int(S.REDUCED[ord(c)]) for c in w]
        want = set()
        for at in range(len(w) + 1):
            end = at >= S.END
            want |= {(end, *r[:at], s, *r[at:]) for s in symbols}
            if at < len(w):
                want |= {(end, *r[:at], *s, *r[at + 1:]) for s in [(), *((s,) for s in symbols)]}
        own = keys(S.neighbourhood, w)
        assert len(own) == len(set(own)) == len(want)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, None), (3, "wörter " * 100_000), (4, "y" * 20_000), (4, "y" * 20_000), (5, "y" * 20_000), (6, "1234 _ \n")]
    rows += [(7, " ".join(["z" * 20_000 + "q"] * 9 + ["m" * k for k in (39, 40, 41, 42) for _ in range(3 ** (k - 37))])), (8, ("z" * 20_000 + " ") * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({c: F.lit("mine") for c in ("id", "t", "k", "n", "word", "key", "near", "form", "root", "best", "f", "at")})
    assert got(S.spelling_variants(df)) == brute(rows)
    assert S.spelling_variants(df.limit(0)).collect() == []
    for wrong in ({"min_chars": 4}, {"ratio": 1}):
        with pytest.raises(ValueError):
            S.spelling_variants(df, **wrong)
