import math
from collections import Counter

import duckdb
import pytest

from tsflow.llm import quality_rules as Q

WHITE = " \t\n\x0b\x0c\r"


def brute(text):
    t = text or ""
    for c in WHITE[1:]:
        flat = t if c == "\t" else flat
        flat = flat.replace(c, " ")
    words = [w for w in flat.split(" ") if w]
    seen = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.strip(WHITE)]
    return (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c d e f g h"), (5, "a b c d e f g h " * 3), (6, "x " * 40), (7, "é ü z 漢字 🙂 #*$%&|<>"),
        (8, "line\nline\n\n line\nline"), (9, "w1 w2 w3 w4 w5 w6 w7 w8 q w1 w2 w3 w4 w5 w6 w7 w8 z w2 w3 w4 w5 w6 w7 w8 z"), (9, "w"), (None, "a b"),
        (10, " ".join(f"w{i % 977}" for i in range(20000))), (11, " ".join(f"u{i}" for i in range(50000)) + "\r\n\x0b" + " ".join(f"u{i}" for i in range(9)))]


def test_statistics(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS t", "2 AS id", "3 AS n_words", "'w' AS w")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.statistics(df).collect()]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t in ROWS), key=str)


def test_verdicts_and_empty(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = Q.judge(df).collect()
    assert all(not r.kept for r in got if r.base_failed) and len(got) == len(ROWS)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert Q.judge(df.limit(0)).count() == 0
    kept = Q.keep_good(df.selectExpr("*", "'x' AS row", "1 AS kept"))
    assert kept.columns == ["doc_id", "text", "row", "kept"]


def test_em_finds_accurate_rules():
    import random
    r = random.Random(2)
    seen, truth = Counter(), []
    for _ in range(5000):
        good = r.random() < .8
        v = tuple((Q.GOOD if good else Q.BAD) if r.random() < p else r.choice((Q.ABSTAIN, Q.GOOD, Q.BAD)) if not good else Q.ABSTAIN
                  for p in (.9, .8, .3, .5))
        seen[v] += 1
        truth.append((good, v))
    prior, w = Q.fit(list(seen.items()), 4)
    right = sum((prior + sum(w[j][x] for j, x in enumerate(v)) > 0) == good for good, v in truth)
    assert right / 5000 > .9
    assert Q.fit([], 4)[0] > 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_labels(spark, sf):
    """Labels are never seen by the fit."""
    got = {r.doc_id: r.kept for r in Q.judge(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).select("doc_id", "kept").collect()}
    rows = duckdb.sql(f"SELECT doc_id, quality FROM '/root/testdata/{sf}/labels.parquet'").fetchall()
    good, bad = [i for i, q in rows if q == 1], [i for i, q in rows if q == 0]
    long = [i for i in good if got[i]]
    assert len(long) / len(good) > .95
    assert sum(not got[i] for i in bad) / len(bad) > .95


@pytest.mark.parametrize("share", [.01, .1, .35])
def test_junk_share_does_not_turn_verdicts(spark, share):
    """Junk of which only one rule says so, as a small and as a large part of the corpus."""
    n = 400
    words = lambda i: " ".join(f"word{(i * 31 + k * 7) % 977}" for k in range(60))
    rows = [(i, words(i) + (" #$%&" * 15 if i < share * n else "")) for i in range(n)]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any(r.base_failed for r in got)
    assert [r.doc_id for r in got if not r.kept] == [i for i in range(n) if i < share * n]


def posteriors(seen, n_rules):
    """The same estimate from one list of votes per document, without numbers shared by equal votes."""
    docs = [v for v, n in seen.items() for _ in range(n)]
    good = [.1 if Q.BAD in v else .9 for v in docs]
    for _ in range(60):
        odds = [4.0] * len(docs)
        for j in range(n_rules):
            on = lambda x, g: sum(p for p, v in zip(g, docs, strict=True) if v[j] == x)  # noqa: B023, E731
            ill = [1 - p for p in good]
            held = 1 + on(Q.BAD, [1] * len(docs))
            usual = 2 * (1 + on(Q.GOOD, [1] * len(docs))) / (2 + len(docs))
            ratio = {Q.BAD: (on(Q.BAD, good) + held / 101) / (on(Q.BAD, ill) + held * 100 / 101) / 4, Q.ABSTAIN: 1.0,
                     Q.GOOD: (on(Q.GOOD, good) + usual) / (sum(good) + 2) / ((on(Q.GOOD, ill) + usual) / (sum(ill) + 2))}
            odds = [o * ratio[v[j]] for o, v in zip(odds, docs, strict=True)]
        good = [o / (1 + o) for o in odds]
    return dict(zip(docs, good, strict=True))


@pytest.mark.parametrize("share", [.01, .1, .35])
def test_fit_matches_brute_force(share):
    fine, junk, short = (2, 2, 2, 1), (2, 2, 2, 0), (0, 2, 0, 1)
    seen = Counter({fine: round(500 * (1 - share)), junk: round(500 * share), short: 20})
    prior, w = Q.fit(list(seen.items()), 4)
    want = posteriors(seen, 4)
    for v in seen:
        assert 1 / (1 + math.exp(-prior - sum(w[j][x] for j, x in enumerate(v)))) == pytest.approx(want[v], abs=1e-6)
    assert want[fine] > .5 > max(want[junk], want[short])


def test_accurate_rules_outweigh_a_weak_one():
    import random
    r = random.Random(1)
    seen = Counter()
    for _ in range(5000):
        good = r.random() < .8
        seen[tuple((Q.GOOD if good else Q.BAD) if r.random() < .85 else Q.ABSTAIN for _ in range(3)) + ((Q.BAD if r.random() < .15 else Q.ABSTAIN),)] += 1
    prior, w = Q.fit(list(seen.items()), 4)
    assert prior + sum(w[j][Q.GOOD] for j in range(3)) + w[3][Q.BAD] > 0 > prior + w[3][Q.BAD]
