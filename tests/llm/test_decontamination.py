from collections import defaultdict

import duckdb
import regex
from pyspark.sql import functions as F

from tsflow.llm import decontamination as D
from tsflow.llm.queries import QUERIES

def template(text):
    """(template word, placeholder and value or None) per token, from the text's tokens one by one."""
    text = text or ""
    out, before = [], 0
    for m in regex.finditer(r"\p{N}+(?:[.,:/]\p{N}+)*|[\p{L}\p{M}]+", text):
        raw, gap = m.group(), text[before:m.start()]
        low = raw.lower()
        after_number = out and out[-1][0] == D.NUMBER
        # a replaced number leaves a blank behind it
        blanks = len(gap) - len(gap.rstrip(" ")) + (1 if after_number and not gap.strip(" ") else 0)
        edge = (gap.rstrip(" ") or (text[before - 1] if before else ""))[-1:]
        title = regex.fullmatch(r"\p{Lu}[\p{Ll}\p{M}]+", raw) and not regex.match(r"\p{N}", text[m.end():m.end() + 1] or " ")
        if regex.match(r"\p{N}", raw):
            kind = D.NUMBER
        elif after_number and gap in ("", " ") and low in D.UNITS and not regex.match(r"\p{N}", text[m.end():m.end() + 1] or " "):
            kind = D.UNIT
        elif title and 1 <= blanks <= 3 and edge and edge not in ".!?" and not edge.isspace():
            kind = D.NAME
        else:
            kind = None
        out.append((kind or low, kind and kind + low))
        before = m.end()
    return out


def brute(docs, bench, window=8, shortest=5, share=.3):
    index, total = defaultdict(list), {}
    items = {i: template(t) for i, t in bench}
    for i, t in items.items():
        n = min(len(t), window)
        if n < shortest:
            continue
        total[i] = len(t) - n + 1
        for k in range(total[i]):
            index[tuple(w for w, _ in t[k:k + n])].append((i, k))
    out = []
    for d, text in docs:
        t, found = template(text), defaultdict(list)
        for n in {len(k) for k in index}:
            for k in range(len(t) - n + 1):
                for i, b in index.get(tuple(w for w, _ in t[k:k + n]), ()):
                    found[i, k - b].append((b, [(x[1], y[1]) for x, y in zip(items[i][b:b + n], t[k:k + n], strict=True) if x[1] or y[1]]))
        covered = defaultdict(set)
        for (i, _), hits in found.items():
            pairs = {p for _, ps in hits for p in ps}
            if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                covered[i] |= {b for b, _ in hits}
        out += [(d, i, total[i], len(c)) for i, c in covered.items() if len(c) >= share * total[i]]
    return sorted(out, key=str)


BENCH = [(1, "A train travels from Paris to Lyon at 120 km per hour for 3 hours, then Paris is left behind by 120 km of track."),
         (2, "What is the boiling point of water in plain words, please?"), (3, "too short item"), (4, "six words are just enough here"), (5, None), (6, "")]
DOCS = [(1, "Intro. A train travels from Berlin to Köln at 80 miles per hour for 5 hours, then Berlin is left behind by 80 miles of track. End."),
        (2, "A train travels from Berlin to Köln at 80 miles per hour for 5 hours, then Rome is left behind by 95 miles of track."),
        (3, "WHAT IS THE BOILING POINT OF WATER -- IN PLAIN WORDS!! PLEASE"), (4, "what is the boiling point of lead"), (5, None), (6, ""),
        (7, "and so six words, are: just enough HERE we are"), (7, "and so six words, are: just enough HERE we are"), (None, "six words are just enough here"),
        (8, "filler word " * 30000 + "what is the boiling point of water in plain words please"), (9, "0 1 2 3 4 5 6 7 8 9 Paris Lyon Rome")]


def test_reparameterised_questions(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"tokens": F.lit(1), "t1": F.lit("x"), "hash": F.lit(2)})
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("item", F.lit("z"))
    got = sorted(map(tuple, D.leaks(docs, bench).collect()), key=str)
    assert got == brute(DOCS, BENCH)
    assert {(d, i) for d, i, *_ in got} == {(1, 1), (3, 2), (7, 4), (None, 4), (8, 2)}
    kept = D.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 9]


def test_empty_tables_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert D.leaks(docs.limit(0), bench).count() == 0
    assert D.leaks(docs, bench.limit(0)).count() == 0 and D.drop_leaking(docs, bench.limit(0)).count() == len(DOCS)
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 3)
    assert sorted(map(tuple, D.leaks(docs, bench).collect()), key=str) == brute(DOCS, BENCH)


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    bench = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    got = sorted(map(tuple, QUERIES["op9_decontamination"](spark, sf).collect()), key=str)
    assert got == brute(docs, bench) and got


def found(spark, docs, bench, **options):
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), **options)
    return sorted(map(tuple, got.collect()), key=str)


def test_repeated_items_texts_under_one_id_and_null_ids(spark):
    one, two = "six words are just enough here", "another text of which all the words are in lower case"
    third = "yet one more text under no id that some page holds whole"
    bench = [(1, one)] * 5 + [(2, one), (2, two), (None, third), (None, third), (None, two)]
    docs = [(1, one), (2, two), (3, third)]
    assert found(spark, docs, bench) == sorted([(1, 1, 1, 1), (1, 2, 1, 1), (2, 2, 4, 4), (2, None, 4, 4), (3, None, 5, 5)], key=str)


def test_one_changed_value_leaves_the_other_windows(spark):
    plain = "then all of the words that come after them stay just as they were in the book of old"
    bench = [(1, f"take 12 of these and 15 of those and 12 more, {plain}")]
    whole = len(template(bench[0][1])) - 7
    edited = f"take 12 of these and 15 of those and 13 more, {plain}"  # the second 12 reads 13
    equal = f"take 15 of these and 15 of those and 15 more, {plain}"  # 12 and 15 became equal
    got = found(spark, [(1, edited), (2, equal), (3, "take 12 of these and 15 of those and 13 more, no word after it")], bench)
    # the last number is word 9, so the windows from word 10 on hold none; in both documents a 12 conflicts before.
    # Of the first document, the first two windows are there word for word.
    assert got == [(1, 1, whole, whole - 8), (2, 1, whole, whole - 10)]


def test_exact_copies_in_any_context_and_case(spark):
    short, rich = "What is the capital of France?", "Der Hund des Nachbarn jagt die Katze der Frau Meier durch den Garten am Haus"
    bench = [(1, short), (2, rich), (3, "It costs 12 dollars in Rome or Paris")]
    docs = [(1, f"Q: {short}"), (2, f"1) {short}"), (3, "one asks What is the capital of France at times"), (4, short.lower()), (5, rich.upper()), (6, rich.lower()),
            (7, "so, What is the capital of Peru?"), (8, "it costs 12 dollars in rome or paris"), (9, "it costs 13 dollars in rome or paris"),
            (10, "What was the capital of France"), (11, f"Hier ist {rich}")]
    got = found(spark, docs, bench)
    n = len(rich.split()) - 7
    assert sorted(got) == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 1, 1, 1), (4, 1, 1, 1), (5, 2, n, n), (6, 2, n, n), (7, 1, 1, 1), (8, 3, 1, 1), (11, 2, n, n - 1)]


def test_windows_of_the_documents_are_worked_out_once(spark, monkeypatch):
    plans, cut = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    docs = [*DOCS, (10, "of four words only")]
    assert found(spark, docs, BENCH) == brute(docs, BENCH)
    search = next(p for p in plans if "posexplode" in p and "Join" in p)
    # items of six words and of eight: two passes over the documents, each of which splits the texts once
    assert search.count("regexp_extract_all(") == search.count("split(") == 2
