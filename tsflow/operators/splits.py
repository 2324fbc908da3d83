"""Train / val / test splits and batching, all deterministic and lazy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsflow.functions.core import hash_bucket, hash_int, permuted
from tsflow.operators.order import global_rank

SPLITS = ("train", "val", "test")


def _ranges_to_rows(df: DataFrame, pos: str, ranges: list) -> DataFrame:
    """Tag each row with every split whose [lo, hi) contains ``pos`` (rows may repeat:
    val/test start ``lookback`` rows early, as in the reference)."""
    arr = F.array(*[F.struct(F.lit(name).alias("s"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
                    for name, lo, hi in ranges])
    tagged = df.withColumn("_sp", F.explode(F.filter(arr, lambda r: (F.col(pos) >= r["lo"]) & (F.col(pos) < r["hi"]))))
    return tagged.withColumn("split", F.col("_sp.s")).drop("_sp")


def fixed_borders(train_end: int, val_end: int, test_end: int, lookback: int, percent: int = 100,
                  pretrain: bool = False) -> list[tuple[str, int, int]]:
    """Borders of the fixed split (optionally few-shot ``percent`` and the pretrain layout)."""
    if pretrain:
        b1 = [0, val_end - lookback, val_end - lookback]
        b2 = [val_end, test_end, test_end]
    else:
        b1 = [0, train_end - lookback, val_end - lookback]
        b2 = [train_end, val_end, test_end]
    if percent != 100:
        b2[0] = (b2[0] - lookback) * percent // 100 + lookback
    return list(zip(SPLITS, b1, b2))


def split_fixed(df: DataFrame, pos: str, train_end: int, val_end: int, test_end: int, lookback: int,
                percent: int = 100, pretrain: bool = False) -> DataFrame:
    borders = fixed_borders(train_end, val_end, test_end, lookback, percent, pretrain)
    return _ranges_to_rows(df, pos, [(s, F.lit(lo), F.lit(hi)) for s, lo, hi in borders])


def split_ratio(df: DataFrame, pos: str, lookback: int, train: float = 0.7, test: float = 0.2,
                percent: int = 100, keys: Sequence[str] = ()) -> DataFrame:
    """70/10/20 split on the row count ``n`` (per ``keys`` group, or the whole table)."""
    keys = list(keys)
    if keys:
        cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        d = df.join(cnt, on=keys)
    else:
        # one-row count table, joined on a constant key (broadcast; size 1)
        cnt = df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
        d = df.withColumn("_k", F.lit(1)).join(F.broadcast(cnt), on="_k").drop("_k")
    n = F.col("_n")
    n_train = F.floor(F.lit(float(train)) * n)
    n_test = F.floor(F.lit(float(test)) * n)
    n_val = n - n_train - n_test
    tr_hi = n_train
    if percent != 100:
        tr_hi = F.floor((n_train - lookback) * percent / 100) + lookback
    ranges = [("train", F.lit(0), tr_hi), ("val", n_train - lookback, n_train + n_val),
              ("test", n - n_test - lookback, n)]
    return _ranges_to_rows(d, pos, ranges).drop("_n")


def split_groups(df: DataFrame, keys: Sequence[str], seed: int = 42, bounds: tuple = (0.6, 0.7),
                 hex_bucket: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """Whole groups to one split: distinct keys in md5(seed, key) order, borders ``floor(b * n)``.

    Returns one row per key: ``(keys, keep, split, rank, split_rank)``; ``keep`` columns are constant
    per key.  The global rank is a
    bucketed rank on the hash prefix (16 ** hex_bucket buckets of equal expected size; more
    digits for more than some 10 ** 11 keys), never a one-task window.
    """
    keys = list(keys)
    distinct = df.groupBy(*keys).agg(*(F.first(c).alias(c) for c in keep)) if keep else df.select(*keys).distinct()
    h = hash_int("split", seed, keys)
    ranked = global_rank(distinct.withColumn("_h", h), ["_h", *keys],
                         bucket=hash_bucket("split", seed, keys, hex_bucket), name="rank",
                         bounded_buckets=True)
    total = distinct.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    r = ranked.withColumn("_k", F.lit(1)).join(F.broadcast(total), on="_k").drop("_k")
    b1 = F.floor(F.lit(float(bounds[0])) * F.col("_n"))
    b2 = F.floor(F.lit(float(bounds[1])) * F.col("_n"))
    split = F.when(F.col("rank") < b1, "train").when(F.col("rank") < b2, "val").otherwise("test")
    start = F.when(F.col("rank") < b1, 0).when(F.col("rank") < b2, b1).otherwise(b2)
    return r.select(*keys, *keep, split.alias("split"), "rank", (F.col("rank") - start).cast("bigint").alias("split_rank"))


def with_epochs(df: DataFrame, rank: str, n_col: str, epochs: int, seed: int = 42, tag: str = "epoch",
                shuffled: Column | None = None, name: str = "epoch") -> DataFrame:
    """A row per row and epoch; ``rank`` (0 .. ``n_col`` - 1 within its split) is permuted anew in every epoch where
    ``shuffled`` holds (everywhere by default) and stays elsewhere.  No row moves: the order is a formula."""
    out = df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))))
    place = permuted(F.col(rank), F.col(n_col), tag, seed, F.col(name))
    return out.withColumn(rank, place if shuffled is None else F.when(shuffled, place).otherwise(F.col(rank)))


def with_batches(df: DataFrame, rank: str, size: int, n_col: str | None = None, drop_last: bool = False,
                 name: str = "batch_id") -> DataFrame:
    """``batch_id = rank div size``; ``drop_last`` keeps only full batches (needs the count ``n_col``)."""
    out = df.withColumn(name, F.floor(F.col(rank) / size).cast("bigint")) \
            .withColumn("batch_seq", (F.col(rank) % size).cast("bigint"))
    if drop_last:
        if n_col is None:
            raise ValueError("drop_last needs the row count column")
        out = out.where(F.col(name) < F.floor(F.col(n_col) / size))
    return out
