import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsflow.llm import ngram_join as N
from tsflow.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"

WHITE = " \t\n\x0b\x0c\r"


def brute_set(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    return frozenset(tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1))))


def brute(rows, k=3, percent=90):
    """[(id, n, component)] by comparing every two sets that share a shingle."""
    sets = sorted({s for _, t in rows if (s := brute_set(t, k))}, key=sorted)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    lists = {}
    for i, s in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in lists[g] if j < i}:
            shared = len(s & sets[j])
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least, root = {}, {s: find(i) for i, s in enumerate(sets)}
    for i, t in rows:
        s = brute_set(t, k)
        if s and i is not None:
            least[root[s]] = min(i, least.get(root[s], i))
    return sorted(((i, len(s), least.get(root[s]) if s else i) for i, t in rows for s in [brute_set(t, k)]), key=str)


def got(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(df, **kw).collect()), key=str)


def edited(rng, words, k):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        words[at:at + rng.choice((0, 1))] = [rng.choice("abcdefgh") * rng.randint(1, 6)] * rng.choice((0, 1, 1))
    return words


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_matches_brute_force(spark, percent):
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "One", "one two", "one two three", "ONE two\tthree"]
    for size in (3, 5, 9, 12, 14, 20, 23, 30, 45, 70, 140, 1500):
        for _ in range(4):
            base = rng.choices(vocabulary, k=size)
            texts += [" ".join(edited(rng, base, k)) for k in (0, 0, 1, 1, 2, size // 30 + 1, size // 15 + 1)]
    rows = list(enumerate(texts)) + [(None, texts[20]), (None, "nobody else says this"), (7, texts[40])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, percent=percent) == brute(rows, percent=percent)


@pytest.mark.parametrize("boundary", [1, 12, 25, 41])
def test_any_boundary_gives_the_same(spark, boundary, monkeypatch):
    monkeypatch.setattr(N, "choose_boundary", lambda *_: boundary)
    rng = random.Random(boundary)
    rows = []
    for size in (4, 12, 13, 22, 24, 26, 27, 44, 60):
        base = rng.choices([f"w{i}" for i in range(60)], k=size)
        rows += [(len(rows) + k, " ".join(edited(rng, base, k % 3))) for k in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_bounds():
    for percent in (50, 80, 90):
        for a in range(1, 60):
            for b in N.partners(a, percent):
                c = N.need(a, b, percent)
                assert 100 * c >= percent * (a + b - c) and 100 * (c - 1) < percent * (a + b - c + 1)
                assert a - c < N.first(a, percent)  # the first ones cannot all be missed


def test_documents_match_brute_force(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    result = QUERIES["op11_ngram_join"](spark, SF001)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in result.collect()), key=str) == brute(rows)


def test_hot_copies_links_and_clashing_columns(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(1000 + i, " ".join([*base[:-2], f"x{i}", f"y{i}"])) for i in range(300)]  # all near the base
    clash = {c: F.lit("mine") for c in ("id", "s", "n", "small", "f", "wide", "part", "cells", "a", "token", "root", "node", "least", "key")}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    assert {c for _, _, c in got(df)} == {0}
    assert got(df.limit(0)) == []


def test_long_text_and_refusal(spark):
    long = " ".join(map(str, np.random.default_rng(1).integers(0, 10**9, 200_000)))
    rows = [(1, long), (2, long + " more"), (3, "x" * 1_000_000), (4, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [c for _, _, c in got(df)] == [1, 1, 3, 4]
    with pytest.raises(ValueError):
        N.jaccard_components(df, percent=40)


def test_two_sets_meet_where_their_lists_first_cross(spark):
    zero = [0] * N.NARROW
    lists = {1: [11, 12, 13], 2: [11, 12, 13], 3: [19, 12, 13], 4: [11, 12, 13]}  # 4 is of the component of 1
    rows = [(token, a, 100, p, tokens[p - 1] if p else None, "x" if a in (1, 4) else f"y{a}", zero)
            for a, tokens in lists.items() for p, token in enumerate(tokens)]
    here = spark.createDataFrame(rows, "token long, a long, n int, p int, before long, root string, f array<long>")
    assert sorted(map(tuple, N.meetings(here, 10, 90).collect())) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]


def test_family_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(250)]
    texts = []
    for _ in range(60):  # some pairs are linked, most are not
        words = list(base)
        for at in rng.sample(range(0, 250, 4), 5):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
