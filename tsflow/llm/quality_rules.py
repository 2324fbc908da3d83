"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at one statistic of a text and votes good, bad, or abstains.  Documents are
counted per combination of votes over the whole corpus; expectation-maximisation on that table
(at most 3^rules rows, whatever the corpus) estimates how often each rule gives each vote in
good and in bad documents.  A document's posterior probability of
being good is then a sum of learned log-odds, an expression over its votes.  A base filter of
two fixed conditions goes first in the verdict.

No document text is shuffled: the corpus is scanned once for the counts, once for the verdicts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsflow.llm.common import let

GOOD, ABSTAIN, BAD = 2, 1, 0
BLANK = r"[\x20\x09-\x0D]"
NO_BLANK = r"[^\x20\x09-\x0D]"
WINDOW = 8
TRUST, TRUSTED = 100, 1.0

#: name: (statistic, good if in this range (None: never), bad if outside that range).  A rule on
#: junk abstains where it sees none: that a text lacks symbols says little about its quality.
RULES = {
    "length": ("n_words", (40, math.inf), (20, math.inf)),
    "word_length": ("try_divide(word_chars, n_words)", (3, 11), (2, 20)),
    "variety": ("try_divide(n_distinct_words, sqrt(n_words))", (4, math.inf), (3, math.inf)),
    "symbols": ("try_divide(n_symbols, n_words)", None, (0, 0.2)),
    "exclamation": ("try_divide(n_exclamations, n_words)", None, (0, 0.25)),
    "capitals": ("try_divide(n_capitals, word_chars)", None, (0, 0.5)),
    "repeated_lines": ("try_divide(n_dup_lines, n_lines)", None, (0, 0.4)),
    "repeated_words": ("try_divide(n_repeat_words, n_words)", None, (0, 0.3)),
}


def _repeat_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                           lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(WINDOW))))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = let(ranked, lambda s: F.filter(s, lambda e, k: F.get(s, k - 1)["h"].eqNullSafe(e["h"])
                                              | F.get(s, k + 1)["h"].eqNullSafe(e["h"])))
        at = F.sort_array(F.transform(again, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, start, lambda a, p: F.struct(
            (p + WINDOW).alias("upto"), (a["n"] + p + WINDOW - F.greatest(a["upto"], p)).alias("n")))["n"]

    def count(h: Column) -> Column:
        return let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long"))
                   .otherwise(covered(w)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, count))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_exclamations, n_capitals, n_distinct_words)`` per row, all counts long (null text: empty)."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    count = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("long")

    def of_words(w: Column) -> Column:
        # a blank at either end leaves an empty piece
        return let(F.filter(w, lambda x: x != ""), lambda x: F.struct(
            F.size(x).cast("long").alias("n_words"), _repeat_words(x).alias("n_repeat_words"),
            F.size(F.array_distinct(x)).cast("long").alias("n_distinct_words")))

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"),
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(NO_BLANK))
    got = rows.select("id", let(F.split("t", BLANK + "+"), of_words).alias("w"), let(lines, of_lines).alias("l"),
                      count(BLANK + "+").alias("word_chars"), count(r"[^#*$%&|<>]+").alias("n_symbols"),
                      count(r"[^!]+").alias("n_exclamations"), count(r"[^\p{Lu}]+").alias("n_capitals"))
    return got.select(F.col("id").alias(doc_id), "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
                      "l.n_lines", "n_exclamations", "n_capitals", "w.n_distinct_words")


def votes(rules: dict = RULES) -> dict[str, Column]:
    """One vote per rule; a statistic that is undefined (no words) abstains."""
    out = {}
    for name, (statistic, good, bad) in rules.items():
        x = F.expr(statistic).cast("double")
        fits = lambda r, x=x: (x >= F.lit(float(r[0]))) & (x <= F.lit(float(r[1])))
        out[name] = F.when(fits(good) if good else F.lit(False), GOOD).when(~fits(bad), BAD).otherwise(ABSTAIN)
    return out


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, good_share: float = 0.8, rounds: int = 60) -> tuple[float, list[list[float]]]:
    """Expectation-maximisation over ``(votes, documents)``; returns the log-odds of good
    without any vote, and those that each vote of each rule adds (an abstention adds none).

    It starts from the rules' meaning: a document with a bad vote is probably bad.  The accuracy of a
    bad vote is read off the rule's own bad votes (how many of them fall on good documents, against
    the fixed share of good documents), so the mix of the corpus is no part of it.  Where a rule
    votes alone its accuracy can't be seen in the data, so ``TRUSTED`` times as many bad votes are
    added, ``TRUST`` times as common in bad documents; good votes of rules that the data show to be
    accurate outweigh them.  Good votes are smoothed by two documents of each class that vote as the
    corpus does, so an unseen vote adds a finite log-odds and one that all documents get adds none.
    The share of good documents is a parameter: abstentions are no evidence of it.
    """
    patterns = sorted(patterns)
    documents = sum(n for _, n in patterns)
    bad_votes, good_votes = ([sum(n for v, n in patterns if v[j] == x) for j in range(n_rules)] for x in (BAD, GOOD))
    good = [0.1 if BAD in v else 0.9 for v, _ in patterns]
    prior, weights = math.log(good_share / (1 - good_share)), [[0.0] * 3 for _ in range(n_rules)]
    for _ in range(rounds):
        total = [[[0.0] * 3 for _ in range(n_rules)] for _ in range(2)]
        for (v, n), g in zip(patterns, good, strict=True):
            for kind, share in ((0, 1 - g), (1, g)):
                for j, x in enumerate(v):
                    total[kind][j][x] += n * share
        for j in range(n_rules):
            bad, fine = total[0][j], total[1][j]
            held = 1 + TRUSTED * bad_votes[j]
            weights[j][BAD] = math.log(fine[BAD] + held / (1 + TRUST)) - math.log(bad[BAD] + held * TRUST / (1 + TRUST)) - prior
            usual = 2 * (1 + good_votes[j]) / (2 + documents)
            weights[j][GOOD] = math.log((fine[GOOD] + usual) / (sum(fine) + 2)) - math.log((bad[GOOD] + usual) / (sum(bad) + 2))
        good = [1 / (1 + math.exp(-max(-500, min(500, prior + sum(weights[j][x] for j, x in enumerate(v)))))) for v, _ in patterns]
    return prior, weights


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: dict = RULES,
          min_words: int = 20, max_repeat: int = 30, least: float = 0.5) -> DataFrame:
    """The statistics of every row and ``base_failed``, ``quality`` (posterior), ``kept``.

    Base: fewer than ``min_words`` words, or over ``max_repeat`` per cent of the words in
    repeated windows.  Kept: not so, and a posterior of at least ``least``.  Null and empty
    texts fail the base.  Rows are judged one by one, so repeated rows and null ids stay.
    """
    stats = statistics(docs, doc_id, text)
    cast = votes(rules)
    counted = stats.select(*(c.alias(n) for n, c in cast.items())).groupBy(*cast).agg(F.count(F.lit(1)).alias("__n"))
    patterns = [(tuple(r[:-1]), r[-1]) for r in counted.collect()]  # at most 3 ** len(rules) rows
    prior, weights = fit(patterns, len(cast))
    odds = F.lit(prior)
    for vote, w in zip(cast.values(), weights, strict=True):
        odds = odds + F.when(vote == GOOD, w[GOOD]).when(vote == BAD, w[BAD]).otherwise(w[ABSTAIN])
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return (stats.withColumn("base_failed", base).withColumn("quality", 1 / (1 + F.exp(-odds)))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)))


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns.  Rows are matched to their verdict
    in place: the id given to ``judge`` is the whole row."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"))
    return judge(whole, "row", "text").where("kept").select("row.*")
