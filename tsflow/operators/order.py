"""Explicit order: positions inside groups and global ranks without a one-task window.

``row_number()`` over a whole group sends that group to one task.  Both helpers
here first count rows per (group, bucket) -- a partial aggregate whose output is
tiny -- prefix-sum those counts, and number rows only inside (group, bucket).
The bucket must be a monotone function of the leading order column (a day, a
hash prefix), so bucket order + local order = the total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(order: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: Column | None = None,
                  name: str = "pos", first: tuple[str, Column] | None = None) -> DataFrame:
    """Add a 0-based position of each row inside its ``keys`` group, following ``order``.

    Without ``bucket`` a series is numbered in one task; leave it out only for short series.  With
    ``bucket`` the numbering runs inside (keys, bucket) plus an offset from the
    bucket-count prefix sums, so a hot group is spread over many tasks.
    ``first = (column name, expression)`` also attaches the expression's minimum over the group, from
    the same bucket table.  A bucket should hold many rows of a usual series, so that the bucket
    table is small, and few enough of a hot one for one task.
    """
    keys = list(keys)
    if bucket is None:
        if not keys:
            raise ValueError("numbering a whole table needs a bucket expression")
        w = Window.partitionBy(*keys).orderBy(*_cols(order))
        out = df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
        if first:
            raise ValueError("first needs a bucket expression")
        return out
    # counts per (keys, bucket): a partial aggregate over the key columns only, so its
    # shuffle carries one row per (key, bucket) per task; prefix sums over that small
    # table give each bucket's offset; rows are numbered inside (keys, bucket) only.
    b = df.withColumn("_bkt", bucket)
    least = [F.min(first[1]).alias("_first")] if first else []
    counts = b.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"), *least)
    wk = Window.partitionBy(*keys).orderBy("_bkt") if keys else Window.orderBy("_bkt")
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sel = [*keys, "_bkt", "_off"]
    if first:
        offs = offs.withColumn(first[0], F.min("_first").over(Window.partitionBy(*keys)))
        sel.append(first[0])
    joined = b.join(offs.select(*sel), on=[*keys, "_bkt"], how="inner")
    wl = Window.partitionBy(*keys, "_bkt").orderBy(*_cols(order))
    return (joined.withColumn(name, (F.col("_off") + F.row_number().over(wl) - 1).cast("bigint"))
            .drop("_bkt", "_off"))


def global_rank(df: DataFrame, order: Sequence, bucket: Column, name: str = "rank",
                bounded_buckets: bool = False) -> DataFrame:
    """0-based rank over the whole DataFrame by ``order`` (total), bucketed by ``bucket``.

    The bucket table (one row per bucket) is the only thing ordered globally.  With
    ``bounded_buckets`` (the bucket expression has a fixed range, e.g. 4096 hash prefixes)
    it is broadcast; otherwise (id ranges, days) the join is left to AQE, which broadcasts
    only when the table turns out small at run time.
    """
    b = df.withColumn("_bkt", bucket)
    counts = b.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    o = offs.select("_bkt", "_off")
    joined = b.join(F.broadcast(o) if bounded_buckets else o, on="_bkt", how="inner")
    wl = Window.partitionBy("_bkt").orderBy(*_cols(order))
    return (joined.withColumn(name, (F.col("_off") + F.row_number().over(wl) - 1).cast("bigint"))
            .drop("_bkt", "_off"))


def with_group_count(df: DataFrame, keys: Sequence[str], name: str = "n", count_col: str | None = None) -> DataFrame:
    """Attach the row count of each ``keys`` group (``count(count_col)`` counts non-null values).

    Done as a partial aggregate + equi-join rather than a window over the whole
    group: the aggregate pre-combines map-side and the join of a one-row-per-key
    side is split by AQE when a key is hot.
    """
    cnt = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    agg = df.groupBy(*keys).agg(cnt.alias(name))
    return df.join(agg, on=list(keys), how="inner")
