"""The pipeline against a brute-force version of its stages, and planted cases through all of it."""

import hashlib
import random
import struct
from collections import Counter

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline as P
from .test_decontamination import brute as brute_leaks
from .test_quality import brute as brute_stats
from .test_simhash import brute_components, brute_fp
from tsflow.llm import quality_rules as Q
from tsflow.llm.common import tokenizer_path

WHITE = " \t\n\x0b\x0c\r"


def brute_quality(rows):
    stats, cells = [], []
    for _, t in rows:
        n_words, chars, symbols, dup, repeat = brute_stats(t)
        t = t or ""
        flat = t
        for c in WHITE:
            flat = flat.replace(c, " ")
        n_lines = sum(bool(x.strip(WHITE)) for x in t.split("\n"))
        capitals = sum(c.isupper() for c in t)
        distinct = len({w for w in flat.split(" ") if w})
        div = lambda a, b: a / b if b else None
        values = {"length": n_words, "word_length": div(chars, n_words), "variety": div(distinct, n_words ** .5), "symbols": div(symbols, n_words),
                  "exclamation": div(t.count("!"), n_words), "capitals": div(capitals, chars), "repeated_lines": div(dup, n_lines), "repeated_words": div(repeat, n_words)}
        inside = lambda x, r: r[0] <= x <= r[1]
        cells.append(tuple(Q.ABSTAIN if x is None else Q.GOOD if g and inside(x, g) else Q.ABSTAIN if inside(x, b) else Q.BAD
                           for x, (_, g, b) in ((values[k], Q.RULES[k]) for k in Q.RULES)))
        stats.append((n_words, repeat))
    prior, w = Q.fit(list(Counter(cells).items()), len(Q.RULES))
    return [r for r, (n, rep), v in zip(rows, stats, cells, strict=True)
            if not (n < 20 or 100 * rep > 30 * n) and prior + sum(w[j][x] for j, x in enumerate(v)) >= 0]


def brute_lines(rows):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(WHITE))
    docs = Counter(k for _, t in rows for k in {key(x) for x in t.split("\n")})
    out = []
    for i, t in rows:
        ls = t.split("\n")
        kept = [x for x in ls if not key(x) or docs[key(x)] < 10]
        if len(kept) == len(ls) or "\n".join(kept):
            out.append((i, "\n".join(kept)))
    return out


def brute(rows, bench):
    rows = brute_lines(brute_quality(rows))
    comps = brute_components([(i, brute_fp(t)) for i, t in rows])
    rows = [r for r, (i, _, c) in zip(rows, comps, strict=True) if i == c]
    leaking = {i for i, *_ in brute_leaks(rows, bench)}
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        if i not in leaking:
            ids = lib.encode(t, add_special_tokens=False).ids
            out.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=str)


def test_pipeline_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    bench = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    got = sorted(map(tuple, P.run(spark, sf).collect()), key=str)
    assert got == brute(rows, bench) and len(got) > 100


def test_stages_keep_columns_and_find_planted_cases(spark, tmp_path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(2, 9)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(n // 12 + 1))
    item = "Which of the old rivers runs past the stone mill before it meets the wide and shallow northern sea again"
    rows = [(i, prose(120)) for i in range(60)]
    copy = prose(200)
    rows += [(100, copy), (101, copy), (102, copy + " "), (103, "Shared line of all\n" + prose(60)), (104, prose(60) + "\n" + item + "\n" + prose(60)),
             (105, "BUY!! NOW!! " * 50), (106, "$$$ ### " * 60), (107, None), (108, ""), (109, "too short")]
    rows += [(200 + i, prose(50) + "\nshared LINE of all ") for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, a int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for _, stage in P.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    left = {x.doc_id: x for x in at.collect()}
    assert set(left) == {*range(60), 100, 103, *range(200, 212)}
    assert all("shared line" not in x.text.lower() and x.n_chars == len(x.text) for x in left.values())
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
