"""URL filter: ordered host/path rules, and a Bloom filter cascade for listed hosts.

The cascade holds listed keys without a false answer.  Level 1 is a Bloom filter of the listed
keys; level 2 is one of the unlisted keys that level 1 wrongly lets through; level 3 is one of
the listed keys that level 2 wrongly holds; and so on until a level makes no error.  A key is
listed if the first level that lacks it has an even number (or, past the last, if that number
is odd).  Because the errors are taken over every key of the corpus (its complete host
universe), membership is exact for each row and rows need no join.

Each level is one row of 64-bit words that reaches the rows as a scalar subquery.  Its size is
known from the key count before it is built; a level beyond ``max_words`` is an exact semi join
on the key instead, so nothing unbounded is broadcast.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsflow.llm.common import A_Z, a_z, cut


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), A_Z, a_z)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (of equal length: the first given) and its verdict, or nulls.

    A rule ``host/path`` fits its host and all subdomains where the path starts with its path.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _slot(key: Column, level: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * 16 + j), key), F.lit(bits))


class Level:
    """One filter: ``holds(key)`` as an expression."""

    def __init__(self, keys: DataFrame, n: int, level: int, rate: float) -> None:
        hashes = max(1, round(-math.log2(rate)))
        self.level, self.hashes = level, hashes
        self.words = max(1, math.ceil(n * hashes / math.log(2) / 64))
        self.bits = self.words * 64
        spark = keys.sparkSession
        slots = keys.select(F.explode(F.array(*(_slot(F.col("key"), level, j, self.bits) for j in range(hashes)))).alias("slot"))
        words = slots.groupBy(F.expr("slot div 64").alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("set"))
        dense = (spark.range(self.words).withColumnRenamed("id", "word").join(words, "word", "left")
                 .select(F.struct("word", F.coalesce("set", F.lit(0).cast("long")).alias("set")).alias("w")))
        row = dense.agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["set"]).alias("words"))
        self.row = cut(row)

    def holds(self, key: Column) -> Column:
        words = self.row.scalar()
        out = None
        for j in range(self.hashes):
            slot = _slot(key, self.level, j, self.bits)
            word = F.get(words, F.floor(slot / 64).cast("int"))
            hit = F.getbit(word, (slot % 64).cast("int")) == 1
            out = hit if out is None else out & hit
        return out


class Cascade:
    """Exact membership of the keys marked ``listed`` among all rows of ``universe``.

    ``universe`` is ``(key string, listed boolean)``, one row per key, stored (it is scanned
    once per level).  ``max_words`` bounds what one level sends to the tasks (8 bytes each).
    """

    def __init__(self, universe: DataFrame, max_words: int = 1 << 20, rate: float = 0.25) -> None:
        self.levels: list[Level] = []
        self.exact: DataFrame | None = None
        holds, rejects = universe.where("listed").select("key"), universe.where("NOT listed").select("key")
        n, m = holds.count(), rejects.count()
        self.n_listed, self.n_keys = n, n + m
        while n:
            # level 1 pays for its false positives over all other keys, later ones are small
            p = rate if self.levels else min(rate, max(1e-6, n / (math.sqrt(2) * max(m, 1))))
            if n * max(1, round(-math.log2(p))) / math.log(2) / 64 > max_words:
                self.exact = universe.where("listed").select("key")
                self.levels = []
                return
            level = Level(holds, n, len(self.levels) + 1, p)
            self.levels.append(level)
            wrong = rejects.where(level.holds(F.col("key")))
            holds, rejects = wrong, holds
            n, m = wrong.count(), n

    def contains(self, key: Column) -> Column:
        """Whether the key is listed; exact for every key of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(~self.levels[i - 1].holds(key), F.lit(i % 2 == 0)).otherwise(out)
        return out

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` and a boolean column: by the cascade, or by a join where it would be too large."""
        if self.exact is None:
            return df.withColumn(name, self.contains(F.col(key)))
        listed = self.exact.select(F.col("key").alias(key)).withColumn(name, F.lit(True))
        return df.join(listed, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], listed_labels: list[str],
               page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` per row.

    A host is listed if one of its dot-separated labels is in ``listed_labels``.  A url
    that no rule fits is blocked if its host is listed, by the cascade, else allowed.  A null
    url has an empty host and path and is allowed.  Repeated rows and null ids are kept.
    """
    host, path = host_and_path(F.col(url))
    split = pages.select(page_id, host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    listed = F.arrays_overlap(labels, F.array(*(F.lit(x) for x in listed_labels)))
    universe = cut(split.select("host").distinct().select(F.col("host").alias("key"), listed.alias("listed")))
    rule, verdict = judge(F.col("host"), F.col("path"), rules)
    marked = Cascade(universe).mark(split, "host", "listed")
    fallback = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select(page_id, "host", "path", rule.alias("rule"), F.coalesce(verdict, fallback).alias("verdict"))


#: The rules of the query, and the host labels of its block list.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
  ELSE 'allow' END AS verdict FROM r
"""
