"""Drop lines that many documents share, with DataFrame functions only.

Lines are exploded and hashed; documents are counted per hash (a document's own repeats are
removed in its row before the count, so the count is a plain partial aggregate); the lines
whose hash is in the over-threshold set are found by a semi join, gathered as positions per
text, and the text is put together again from the other positions.

Only hashes and positions are shuffled for the search.  The result depends on a row's text
alone, so rows are matched to their positions by a 128-bit hash of the text: a null or
repeated id does no harm, and a text with millions of copies is gathered once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsflow.llm.common import BLANKS, cut, hash128, let, lower_ascii


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def common_lines(docs: DataFrame, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """``(a, b)`` hashes of the keys that at least ``min_docs`` rows hold."""
    keys = (docs.select(F.explode(F.array_distinct(F.transform(_lines(F.col(text)), line_key))).alias("key"))
            .where(F.length("key") >= min_chars))
    a, b = hash128(F.col("key"))
    return (keys.select(a.alias("a"), b.alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_docs).select("a", "b"))


def drop_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Every row of ``docs`` as ``(doc_id, n_lines, n_dropped, kept)``; see ``with_kept``."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return with_kept(rows, "text", min_docs, min_chars).select(
        F.col("row.id").alias(doc_id), "n_lines", "n_dropped", "kept")


def with_kept(docs: DataFrame, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """``(row, n_lines, n_dropped, kept)``: the row of ``docs`` as a struct, so that its columns may have any name.

    Each row is a document.  A null or empty text is one empty line.  A key shorter than
    ``min_chars`` code points is never dropped.  A text whose lines all go becomes empty.
    """
    narrow = docs.select(F.col(f"`{text}`").alias("text"))
    # stored, so that the joins below are between plain shuffles and a hot line or text can be split
    common = cut(common_lines(narrow, "text", min_docs, min_chars))
    placed = narrow.withColumns(dict(zip(("t1", "t2"), hash128(F.coalesce("text", F.lit(""))), strict=True)))
    placed = placed.select("t1", "t2", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    placed = placed.select("t1", "t2", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    placed = placed.select("t1", "t2", "at", *(h.alias(n) for h, n in zip(hash128(F.col("key")), "ab", strict=True)))
    gone = cut(placed.join(common, ["a", "b"], "left_semi").groupBy("t1", "t2").agg(F.collect_set("at").alias("gone")))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(h.alias(n) for h, n in zip(hash128(body), ("t1", "t2"), strict=True)))
    # hashed are the positions, a row per text; the wide rows stream past them unsorted
    got = packed.join(gone.hint("shuffle_hash"), ["t1", "t2"], "left").drop("t1", "t2")
    whole = F.col("row").getField(text)
    lines = _lines(whole)
    kept = F.when(F.col("gone").isNull(), F.coalesce(whole, F.lit(""))).otherwise(_without(lines, F.col("gone")))
    # one evaluation, however many expressions name the text
    return got.select("row", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.explode(F.array(kept)).alias("kept"))


def _without(lines: Column, gone: Column) -> Column:
    def left(x: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), gone), lambda i: F.get(x, i))
    return F.concat_ws("\n", let(lines, left))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    got = drop_common_lines(docs, doc_id, text, min_docs, min_chars)
    return got.select(doc_id, "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


#: The same result in DuckDB SQL (rows are told apart by number).
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
k AS (SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
j AS (SELECT k.r, k.pos, k.line, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(d.doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j JOIN d USING (r) GROUP BY r
"""
