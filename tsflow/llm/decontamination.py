"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts and benchmark items become templates: numbers, names (title-case words inside a sentence)
and units (after a number) turn into typed placeholders, other words lose case and punctuation.
Windows of ``window`` template tokens are hash-joined.  Matches of one item at one alignment
(document position minus item position) must fill the placeholders consistently: one value of
the item, one value of the document, and the other way round; windows with a value that breaks this
are dropped, and windows without placeholders count in any case.  So a question with other
numbers or names is found, and a chance match of placeholders is not.  What is a name depends on
case and on what stands before, so the first word of an item is taken as a name too, and windows
of plain lower-case words are joined beside the templates: they count as windows without
placeholders.  A document leaks an item
if the windows that are left cover at least ``share`` of the item's windows.

Only benchmark windows are broadcast, in blocks of at most ``BLOCK_WINDOWS`` rows, so documents are
never shuffled for the search; what is grouped afterwards are matches, keyed by a hash of the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsflow.llm.common import cut, hash128, let

BLOCK_WINDOWS = 100_000
NUMBER, UNIT, NAME = "0", "1", "2"  # placeholders; no other word of a template has a digit
#: Words that are units where they follow a number.
UNITS = ("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz ton tons ml cl l liter liters "
         "litre litres gal gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month "
         "months year years c f k degrees percent pct usd eur gbp dollar dollars euro euros pound pounds cent cents hz khz mhz "
         "ghz w kw mw kwh v kv a ma pa kpa bar j kj cal kcal n kb mb gb tb mph kmh kph rpm").split()
A_NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*"
A_UNIT = r"(?i)(?<= 0 ) ?(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{M}\p{N}])"
#: a title-case word after a blank that no sentence end or line break precedes
A_NAME = r"(?=\p{Lu})(?<=[^.!?\s] {1,3})\p{Lu}[\p{Ll}\p{M}]+(?![\p{L}\p{M}\p{N}])"
A_TITLE = r"^\p{Lu}[\p{Ll}\p{M}]+$"
TOKEN = A_NUMBER + r"|[\p{L}\p{M}]+"


def _words(text: Column) -> Column:
    """Template words: placeholders, and other words in lower case without punctuation."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), A_NUMBER, f" {NUMBER} ")
    t = F.regexp_replace(F.regexp_replace(t, A_UNIT, f" {UNIT} "), A_NAME, f" {NAME} ")
    return F.array_remove(F.split(F.lower(t), r"[^\p{L}\p{M}\p{N}]+"), "")


def _values(text: Column, words: Column) -> Column:
    """What each template word stands for: placeholder and value, or null."""
    raws = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0)
    return F.zip_with(words, raws, lambda w, r: F.when(w.isin(NUMBER, UNIT, NAME), F.concat(w, F.lower(r))))


def _plain(words: Column, values: Column) -> Column:
    """The words in lower case without placeholders; a number keeps its mark, so it is no placeholder."""
    return F.zip_with(words, values, lambda w, v: F.when(v.isNull(), w).when(w == NUMBER, v).otherwise(F.substring(v, F.lit(2), F.length(v))))


def _windows(words: Column, length: int) -> Column:
    """Hash of every window of ``length`` template words."""
    def hashes(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - length),
                           lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(length))))
    return let(F.transform(words, lambda w: F.xxhash64(w)),
               lambda h: F.when(F.size(h) < length, F.array().cast("array<bigint>")).otherwise(hashes(h)))


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int, shortest: int) -> DataFrame:
    """``(item, key, length, n_windows, hash, b_at, b_values, as_is)``; ``b_values`` is null without a placeholder,
    ``as_is`` true for the template windows of the text as it stands.
    Each distinct text under an id is an item with a ``key`` of its own; a null id is an id.  Items of fewer than ``window`` tokens are one window; those of fewer than ``shortest`` cannot
    be told from ordinary text and are left out."""
    body = F.col(f"`{text}`").cast("string")
    own = F.col(f"`{item_id}`")
    items = benchmark.select(own.alias("item"), F.xxhash64(own.isNull(), own.cast("string"), body).alias("key"), body.alias("text"))
    items = items.dropDuplicates(["item", "key"]).select("item", "key", "text", _words(F.col("text")).alias("words"))
    items = items.select("item", "key", "text", "words", _values(F.col("text"), F.col("words")).alias("values"),
                         F.least(F.size("words"), F.lit(window)).alias("length")).where(F.col("length") >= shortest)
    items = items.withColumn("n_windows", (F.size("words") - F.col("length") + 1).cast("long"))
    rest = lambda c: F.slice(c, F.lit(2), F.size(c))
    named = items.where(F.regexp_extract("text", TOKEN, 0).rlike(A_TITLE) & F.get("values", F.lit(0)).isNull()).withColumns({
        "values": F.concat(F.array(F.concat(F.lit(NAME), F.get("words", F.lit(0)))), rest(F.col("values"))),
        "words": F.concat(F.array(F.lit(NAME)), rest(F.col("words")))})
    plain = items.withColumns({"words": _plain(F.col("words"), F.col("values")), "values": F.lit(None).cast("array<string>")})
    out = None
    for n in range(shortest, window + 1):
        for kind in (items, named, plain):
            df = kind.where(F.col("length") == n).select("item", "key", "length", "n_windows", "values", F.lit(kind is items).alias("as_is"),
                                                            F.posexplode(_windows(F.col("words"), n)).alias("b_at", "hash"))
            df = df.where(F.col("b_at") == 0) if kind is named else df
            out = df if out is None else out.union(df)
    values = F.slice("values", F.col("b_at") + 1, F.col("length"))
    out = out.withColumn("b_values", F.when(F.exists(values, lambda v: v.isNotNull()), values))
    # without a placeholder the plain window is the template window
    return out.groupBy("item", "key", "length", "n_windows", "hash", "b_at", "b_values").agg(F.max("as_is").alias("as_is"))


def _doc_windows(text: Column, length: int) -> Column:
    """Hashes of the template windows, then as many of the plain windows, null where they are the same."""
    def both(words: Column) -> Column:
        plain = _windows(_plain(words, _values(text, words)), length)
        return let(_windows(words, length), lambda t: F.concat(t, F.zip_with(t, plain, lambda a, b: F.when(a != b, b))))
    return let(_words(text), both)


def _aligned(hits: DataFrame) -> DataFrame:
    """``(t1, t2, item, key, n_windows, length, shift, at, slots, as_is)`` per alignment: item places matched
    without placeholders, and those with placeholders together with the item's values; ``as_is`` are those that template windows match."""
    slot = F.when(F.col("b_values").isNotNull(), F.struct("b_at", "b_values"))
    sure = F.when(F.col("b_values").isNull(), F.col("b_at"))
    return hits.groupBy("t1", "t2", "item", "key", "n_windows", "length", "shift").agg(
        F.collect_set(sure).alias("at"), F.collect_set(slot).alias("slots"),
        F.collect_set(F.when(F.col("as_is"), F.col("b_at"))).alias("as_is"))


def _consistent(aligned: DataFrame, texts: DataFrame) -> DataFrame:
    """The alignments with, in ``at``, the places without placeholders and those whose placeholders are
    filled one to one.  Only texts with placeholders are fetched, each once, together with all
    their alignments."""
    doubtful = aligned.where(F.size("slots") > 0)
    by_text = cut(doubtful.groupBy("t1", "t2").agg(F.collect_list(F.struct("item", "key", "n_windows", "length", "shift", "at", "slots", "as_is")).alias("all")))
    if by_text.isEmpty():
        return aligned.drop("slots", "length")
    held = texts.dropDuplicates(["t1", "t2"]).join(by_text, ["t1", "t2"])
    held = held.select("t1", "t2", "all", "text", _words(F.col("text")).alias("words"))
    held = held.select("t1", "t2", "all", _values(F.col("text"), F.col("words")).alias("values"))

    def twice(x: Column) -> Column:
        return let(F.sort_array(x), lambda s: F.filter(s, lambda v, i: (F.get(s, i - 1) == v) | (F.get(s, i + 1) == v)))

    def agreeing(a: Column) -> Column:
        def of_place(s: Column) -> Column:
            mine = F.slice(F.col("values"), (s["b_at"] + a["shift"] + 1).cast("int"), a["length"])
            pairs = F.zip_with(s["b_values"], mine, lambda b, d: F.when(b.isNotNull(), F.struct(b.alias("b"), d.alias("d"))))
            return F.struct(s["b_at"].alias("b_at"), F.filter(pairs, lambda p: p.isNotNull()).alias("pairs"))

        def keep(places: Column) -> Column:
            pairs = F.array_distinct(F.flatten(F.transform(places, lambda p: p["pairs"])))
            many = let(pairs, lambda p: F.struct(twice(F.transform(p, lambda x: x["b"])).alias("b"), twice(F.transform(p, lambda x: x["d"])).alias("d")))
            return let(many, lambda m: F.transform(F.filter(places, lambda s: ~F.exists(
                s["pairs"], lambda p: F.array_contains(m["b"], p["b"]) | F.array_contains(m["d"], p["d"]))), lambda s: s["b_at"]))
        return F.array_union(a["at"], let(F.transform(a["slots"], of_place), keep))

    sure = held.select("t1", "t2", F.explode(F.transform("all", lambda a: F.struct(
        a["item"].alias("item"), a["key"].alias("key"), a["n_windows"].alias("n_windows"), a["shift"].alias("shift"), agreeing(a).alias("at"), a["as_is"].alias("as_is")))).alias("a"))
    return (aligned.where(F.size("slots") == 0).drop("slots", "length")
            .unionByName(sure.select("t1", "t2", "a.item", "a.key", "a.n_windows", "a.shift", "a.at", "a.as_is")))


def leaked_texts(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 window: int = 8, shortest: int = 5, share: float = 0.3) -> DataFrame:
    """``(t1, t2, item, n_windows, n_matched)``: hash of a leaking text, and what it leaks."""
    items = cut(item_windows(benchmark, item_id, item_text, window, shortest))
    lengths = {r.length: r.n for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    body = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    t1, t2 = hash128(F.coalesce("text", F.lit("")))
    texts = body.select(t1.alias("t1"), t2.alias("t2"), "text")
    found = None
    for length, n in sorted(lengths.items()):
        spread = texts.select("t1", "t2", _doc_windows(F.col("text"), length).alias("all"))
        # outer: for a plain explode the optimizer puts a filter on the array's size below, which works out all windows once more
        spread = spread.select("t1", "t2", F.floor(F.size("all") / 2).cast("int").alias("n"), F.posexplode_outer("all").alias("at", "hash"))
        spread = spread.where(F.col("hash").isNotNull()).withColumn("d_at", F.pmod("at", "n"))
        blocks = math.ceil(n / BLOCK_WINDOWS)
        for block in range(blocks):
            part = items.where((F.col("length") == length) & (F.pmod("hash", F.lit(blocks)) == block))
            # bounded: at most about BLOCK_WINDOWS rows of under 100 values
            hit = spread.join(F.broadcast(part.withColumnRenamed("as_is", "item_as_is")), "hash").select(
                "t1", "t2", "item", "key", "n_windows", "length", "b_at", (F.col("d_at") - F.col("b_at")).alias("shift"), "b_values",
                (F.col("item_as_is") & (F.col("at") < F.col("n"))).alias("as_is"))
            found = hit if found is None else found.union(hit)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], f"t1 long, t2 long, item {benchmark.schema[item_id].dataType.simpleString()}, n_windows long, n_matched long")
    aligned = _consistent(cut(_aligned(found)), texts)
    covered = aligned.select("t1", "t2", "item", "key", "n_windows", "as_is", F.explode("at").alias("at"))
    as_is = F.when(F.array_contains("as_is", F.col("at")), F.col("at"))
    counted = covered.groupBy("t1", "t2", "item", "key", "n_windows").agg(
        F.size(F.collect_set(as_is)).cast("long").alias("as_is"), F.size(F.collect_set("at")).cast("long").alias("n"))
    enough = share * F.col("n_windows")
    return counted.where(F.col("n") >= enough).select(
        "t1", "t2", "item", "n_windows", F.when(F.col("as_is") >= enough, F.col("as_is")).otherwise(F.col("n")).alias("n_matched"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", **options) -> DataFrame:
    """``(doc_id, item_id, n_windows, n_matched)``: one row for each item that a document holds.

    Null and empty texts hold none; an empty benchmark gives no row.  A repeated document gives
    its rows again, a null id stays null; an item that repeats under one id counts once.
    ``n_matched`` counts template windows, and plain ones and the first word as a name with them only
    where template windows alone are too few.  Several texts under one id are items of their own, each with its row; so are those of a null id.
    """
    got = cut(leaked_texts(docs, benchmark, text, item_id, item_text, **options))  # so that hot texts can be split in the join
    t1, t2 = hash128(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    own = docs.select(F.col(f"`{doc_id}`").alias("__id"), t1.alias("t1"), t2.alias("t2"))
    return own.join(got, ["t1", "t2"]).select(F.col("__id").alias(doc_id), F.col("item").alias(item_id), "n_windows", "n_matched")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that leak no item, all columns."""
    got = cut(leaked_texts(docs, benchmark, text, **options).select("t1", "t2").distinct())
    t1, t2 = hash128(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), t1.alias("t1"), t2.alias("t2"))
    return keyed.join(got, ["t1", "t2"], "left_anti").select("row.*")
