"""Series features: moving average / decomposition, circular autocorrelation, lags,
window statistics, prompt text and point-adjusted anomaly flags."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- moving average / decomposition
def moving_avgs(df: DataFrame, keys: Sequence[str], col: str, kernels: dict[str, int], pos: str = "pos",
                block: int | None = 1 << 16) -> DataFrame:
    """Centred moving averages of odd widths ``{name: k}`` with edge replication, in one window pass.

    Rows of a series are numbered 0, 1, ... by ``pos``.  A frame that is cut short by an end of the
    series is filled up with the first or last value.  The frame itself shows that: it holds fewer
    rows than it should, and its outermost row is the series' first or last one, so no second
    shuffle fetches the ends.  ``block`` (None: off) is the size of halo blocks: rows are copied into neighbouring
    blocks within reach of the widest kernel, the window runs per (series, block), and each row is
    kept in its own block, so a long series becomes many tasks.
    """
    if any(k % 2 != 1 for k in kernels.values()):
        raise ValueError("kernel size must be odd")
    part = list(keys)
    reach = (max(kernels.values()) - 1) // 2
    src = df
    if block is not None:
        block = max(block, 2 * reach)
        lo = F.greatest(F.floor((F.col(pos) - reach) / block), F.lit(0)).cast("bigint")
        hi = F.floor((F.col(pos) + reach) / block).cast("bigint")
        src = df.withColumn("_blk", F.explode(F.sequence(lo, hi)))
        part.append("_blk")
    w = Window.partitionBy(*part).orderBy(pos)
    out = {}
    for name, k in kernels.items():
        h = (k - 1) // 2
        before, after = w.rowsBetween(-h, 0), w.rowsBetween(0, h)
        left = F.lit(h + 1) - F.count(F.lit(1)).over(before)
        right = F.lit(h + 1) - F.count(F.lit(1)).over(after)
        out[name] = (F.sum(col).over(w.rowsBetween(-h, h)) + left * F.first(col).over(before)
                     + right * F.last(col).over(after)) / F.lit(float(k))
    d = src.select("*", *(c.alias(n) for n, c in out.items()))
    if block is not None:
        d = d.where(F.floor(F.col(pos) / block) == F.col("_blk")).drop("_blk")
    return d


def moving_avg(df: DataFrame, keys: Sequence[str], col: str, k: int, pos: str = "pos",
               name: str = "trend", block: int | None = 1 << 16) -> DataFrame:
    """One centred moving average; see ``moving_avgs``."""
    return moving_avgs(df, keys, col, {name: k}, pos, block)


def decompose(df: DataFrame, keys: Sequence[str], col: str, kernels, pos: str = "pos",
              block: int | None = 1 << 16) -> DataFrame:
    """trend = moving average (mean of several kernels when a list), seasonal = x - trend."""
    ks = [kernels] if isinstance(kernels, int) else list(kernels)
    names = [f"_t{i}" for i in range(len(ks))]
    d = moving_avgs(df, keys, col, dict(zip(names, ks, strict=True)), pos, block)
    trend = sum((F.col(n) for n in names), F.lit(0.0)) / float(len(ks))
    return d.withColumn("trend", trend).withColumn("seasonal", F.col(col) - F.col("trend")).drop(*names)


def array_moving_avg(x: Column, length: int, k: int) -> Column:
    """Edge-replicated centred moving average of an array of known ``length``."""
    h = (k - 1) // 2
    return F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.aggregate(F.sequence(i - h, i + h), F.lit(0.0),
                              lambda acc, j: acc + F.element_at(x, F.least(F.greatest(j, F.lit(0)),
                                                                           F.lit(length - 1)) + 1)) / float(k))


def decomp_continuation(x: Column, length: int, k: int, label: int, pred: int):
    """Decoder init: trend = last ``label`` trend values ++ window mean x pred;
    seasonal = last ``label`` seasonal values ++ zeros.  Returns (trend, seasonal) arrays."""
    tr = array_moving_avg(x, length, k)
    se = F.zip_with(x, tr, lambda a, b: a - b)
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / float(length)
    trend = F.concat(F.slice(tr, -label, label), F.array_repeat(mean, pred))
    seasonal = F.concat(F.slice(se, -label, label), F.array_repeat(F.lit(0.0), pred))
    return trend, seasonal


# ---------------------------------------------------------------- autocorrelation and lags
def pin(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add ``expr`` as a column that is evaluated exactly once per row.

    Catalyst inlines projected expressions into later projections; an expensive array
    referenced inside a lambda would then run once per element.  A one-element
    ``explode`` is a Generate operator, which later projections cannot be merged into.
    """
    return df.select("*", F.explode(F.array(expr)).alias(name))


def autocorr(x: Column, length: int) -> Column:
    """Circular autocorrelation r[k] = sum_i x[i] * x[(i+k) mod T] of windows of ``length`` values.

    One path for every length: a numpy FFT over one Arrow batch of windows at a time,
    T log T per window.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def correlate(s: pd.Series) -> pd.Series:
        if s.empty:
            return pd.Series([], dtype=object)
        power = np.abs(np.fft.rfft(np.vstack(s.to_numpy()).astype(float), axis=1)) ** 2
        return pd.Series(list(np.fft.irfft(power, n=length, axis=1)), index=s.index)
    return correlate(x)


def top_lags(r: Column, k: int = 5) -> Column:
    """Indices of the k largest r; ties (r[k] = r[T-k]) broken by the smaller lag."""
    pairs = F.transform(r, lambda v, i: F.struct(F.round(-v, 9).alias("nv"), i.alias("lag")))
    return F.slice(F.sort_array(pairs), 1, k)["lag"]


def period_agg(df: DataFrame, x: str, length: int, factor: float = 1.0, r: str | None = None,
               rank_r: str | None = None, name: str = "period_agg") -> DataFrame:
    """Parameter-free period aggregation: take k = int(factor * ln T) top lags, softmax the
    series' correlations at those lags and sum the rolled series weighted by them.

    ``rank_r`` chooses the lags from another correlation column (the batch mean, training
    form: lags shared by a batch, weights still per series); by default the series' own ``r``.
    Built as staged projections so each intermediate array is computed once per row.
    """
    k = max(1, int(factor * math.log(length)))
    d = df if r is not None else pin(df, "_r", autocorr(F.col(x), length))
    rr = F.col(r if r is not None else "_r")
    rk = F.col(rank_r) if rank_r is not None else rr
    pairs = F.transform(F.arrays_zip(rk.alias("q"), rr.alias("v")),
                        lambda z, i: F.struct(F.round(-z["q"], 9).alias("nv"), i.alias("lag"), z["v"].alias("r")))
    d = pin(d, "_top", F.slice(F.sort_array(pairs), 1, k))
    d = d.withColumn("_mx", F.aggregate("_top", F.lit(float("-inf")), lambda a, s: F.greatest(a, s["r"])))
    d = pin(d, "_w", F.transform("_top", lambda s: F.struct(s["lag"].alias("lag"),
                                                             F.exp(s["r"] - F.col("_mx")).alias("e"))))
    d = pin(d, "_den", F.aggregate("_w", F.lit(0.0), lambda a, s: a + s["e"]))
    xc = F.col(x)
    out = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda t: F.aggregate("_w", F.lit(0.0), lambda a, s: a + s["e"] / F.col("_den")
                              * F.element_at(xc, F.pmod(t + s["lag"], F.lit(length)) + 1)))
    return d.withColumn(name, out).drop("_top", "_mx", "_w", "_den", *([] if r is not None else ["_r"]))


def period_agg_full(df: DataFrame, x: str, length: int, factor: float = 1.0, name: str = "period_agg") -> DataFrame:
    """The per-channel form: every channel's own correlation picks its lags and gives its weights.
    ``df`` has one row per (window, channel), so this is ``period_agg`` on each row."""
    return period_agg(df, x, length, factor, name=name)


def shared_lag_corr(df: DataFrame, batch: str, r: str, length: int) -> DataFrame:
    """Training-time variant: the correlation averaged over each batch, so every series of a
    batch shares the same top lags (a plain group-by on the batch id, element-wise mean)."""
    e = df.select(batch, F.posexplode(r).alias("_i", "_v"))
    m = e.groupBy(batch, "_i").agg(F.avg("_v").alias("_v"))
    arr = m.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_a"))
    return df.join(arr.select(batch, F.col("_a")["_v"].alias("r_batch")), on=batch)


def align_len(a: Column, b: Column) -> Column:
    """Bring ``b`` to the length of ``a``: zero-pad when shorter, truncate when longer."""
    return F.when(F.size(b) >= F.size(a), F.slice(b, 1, F.size(a))).otherwise(
        F.concat(b, F.array_repeat(F.lit(0.0), F.size(a) - F.size(b))))


# ---------------------------------------------------------------- window statistics / prompt
def window_stats_cols(x: Column) -> list[Column]:
    """min, max, lower median (sorted[(n-1) div 2]) and trend sign of an array."""
    srt = F.sort_array(x)
    med = F.element_at(srt, F.floor((F.size(x) - 1) / 2).cast("int") + 1)
    diff_sum = F.element_at(x, -1) - F.element_at(x, 1)
    return [F.array_min(x).alias("min_value"), F.array_max(x).alias("max_value"), med.alias("median_value"),
            F.when(diff_sum > 0, F.lit("upward")).otherwise(F.lit("downward")).alias("trend")]


def window_stats(df: DataFrame, x: str) -> DataFrame:
    """Add min_value, max_value, median_value (lower median) and trend for array column ``x``."""
    return df.select("*", *window_stats_cols(F.col(x)))


# The prompt template (the dataset description comes from the prompt bank).
PROMPT_TEMPLATE = (
    "<|start_prompt|>Dataset description: {description}"
    "Task description: forecast the next {pred} steps given the previous {seq} steps information; "
    "Input statistics: min value {min}, max value {max}, median value {median}, "
    "the trend of input is {trend}, top 5 lags are : {lags}<|<end_prompt>|>")


def prompt_text(description: Column, min_v: Column, max_v: Column, median_v: Column, trend: Column,
                lags: Column, seq: int, pred: int) -> Column:
    """The prompt string; numbers printed with ``%.4f``, lags as ``[a, b, c]``."""
    head, rest = PROMPT_TEMPLATE.split("{description}")
    rest = rest.replace("{pred}", str(pred)).replace("{seq}", str(seq))
    a, rest = rest.split("{min}")
    b, rest = rest.split("{max}")
    c, rest = rest.split("{median}")
    d, rest = rest.split("{trend}")
    e, tail = rest.split("{lags}")
    fmt = lambda v: F.format_string("%.4f", v)
    lag_s = F.concat(F.lit("["), F.array_join(F.transform(lags, lambda v: v.cast("string")), ", "), F.lit("]"))
    return F.concat(F.lit(head), description, F.lit(a), fmt(min_v), F.lit(b), fmt(max_v), F.lit(c),
                    fmt(median_v), F.lit(d), trend, F.lit(e), lag_s, F.lit(tail))


# ---------------------------------------------------------------- point adjustment
def point_adjust(df: DataFrame, keys: Sequence[str], gt: str, pred: str, pos: str = "pos",
                 block: int = 1 << 16, name: str = "pred_adj") -> DataFrame:
    """Gaps-and-islands point adjustment: a hit (gt = 1 and pred = 1) anywhere in a run of
    gt = 1 flags the whole run, except position 0 (never back-filled).

    A run is named by the position of the last gt = 0 row before it.  Inside a block of ``block``
    positions that is a window; for the run that a block starts with it is the last gt = 0 row
    of the earlier blocks, from one summary row per block.  So a long series runs in many tasks.
    Only gt = 1 rows meet their run's hit flag, by (block, run), so that a run of any length is
    spread over its blocks; gt = 0 rows pass by.
    """
    keys = list(keys)
    zero = F.when(F.col(gt) == 0, F.col(pos))
    d = df.withColumn("_blk", F.floor(F.col(pos) / block).cast("bigint"))
    ends = d.groupBy(*keys, "_blk").agg(F.max(zero).alias("_z"))
    earlier = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_blk", F.max("_z").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_last", F.max(zero).over(inside)).join(ends, on=[*keys, "_blk"])
    d = d.withColumn("_run", F.coalesce("_last", "_carry", F.lit(-1)))
    flagged = d.where(F.col(gt) == 1)
    parts = flagged.groupBy(*keys, "_blk", "_run").agg(F.max((F.col(pred) == 1).cast("int")).alias("_h"))
    whole = parts.groupBy(*keys, "_run").agg(F.max("_h").alias("_hit"))
    parts = parts.select(*keys, "_blk", "_run").join(whole, on=[*keys, "_run"])
    flagged = flagged.join(parts, on=[*keys, "_blk", "_run"])
    adj = F.when((F.col("_hit") == 1) & (F.col(pos) > 0), F.lit(1)).otherwise(F.col(pred))
    out = [*df.columns]
    return (flagged.select(*out, adj.cast("int").alias(name))
            .unionByName(d.where((F.col(gt) != 1) | F.col(gt).isNull()).select(*out, F.col(pred).cast("int").alias(name))))
