"""Error metrics as aggregate Column lists: every bundle is one ``agg`` (partial + final).

Formulas follow the published definitions (Makridakis 1993 sMAPE; Hyndman &
Koehler 2006 MASE) and the reference's exact variants noted per function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsflow.functions.core import divide_no_nan

EPS = 1e-8  # fixed value: the guard added to the denominator of the eps bundle


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basic_aggs(pred, true) -> list[Column]:
    """mae, mse, rmse, mape, mspe; a zero target gives null (skipped) and is counted."""
    p, t = _c(pred), _c(true)
    e = p - t
    rel = F.try_divide(e, t)
    return [F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(rel)).alias("mape"), F.avg(rel * rel).alias("mspe"),
            F.count(F.when(t == 0, 1)).alias("n_zero_true")]


def eps_aggs(pred, true, mask=None) -> list[Column]:
    """Guarded bundle (mse, mae, rmse, mape, mspe) with ``abs(e) / (y + 1e-8)`` (signed y).

    With ``mask``: sums weighted by the mask over the mask sum, except mspe which is a
    mean over all cells of the masked squared ratio (the reference's definition).
    """
    p, t = _c(pred), _c(true)
    ae = F.abs(p - t)
    se = (p - t) * (p - t)
    ratio = ae / (t + F.lit(EPS))
    if mask is None:
        return [F.avg(se).alias("mse"), F.avg(ae).alias("mae"), F.sqrt(F.avg(se)).alias("rmse"),
                F.avg(ratio).alias("mape"), F.avg(ratio * ratio).alias("mspe")]
    m = _c(mask)
    sm = F.sum(m)
    return [F.try_divide(F.sum(se * m), sm).alias("mse"), F.try_divide(F.sum(ae * m), sm).alias("mae"),
            F.sqrt(F.try_divide(F.sum(se * m), sm)).alias("rmse"), F.try_divide(F.sum(ratio * m), sm).alias("mape"),
            F.avg(ratio * ratio * m).alias("mspe")]


def smape_loss_agg(pred, true, mask, name: str = "smape_loss") -> Column:
    p, t, m = _c(pred), _c(true), _c(mask)
    return (F.lit(200.0) * F.avg(divide_no_nan(F.abs(p - t), F.abs(p) + F.abs(t)) * m)).alias(name)


def mape_loss_agg(pred, true, mask, name: str = "mape_loss") -> Column:
    p, t, m = _c(pred), _c(true), _c(mask)
    return F.avg(F.abs((p - t) * divide_no_nan(m, t))).alias(name)


def mse_loss_agg(pred, true, mask=None, name: str = "mse_loss") -> Column:
    p, t = _c(pred), _c(true)
    if mask is None:
        return F.avg((p - t) * (p - t)).alias(name)
    m = _c(mask)
    return F.try_divide(F.sum((p - t) * (p - t) * m), F.sum(m)).alias(name)


def metrics(df: DataFrame, pred: str, true: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*basic_aggs(pred, true))


def metrics_eps(df: DataFrame, pred: str, true: str, by: Sequence[str] = (), mask: str | None = None) -> DataFrame:
    return df.groupBy(*by).agg(*eps_aggs(pred, true, mask))


def rse(df: DataFrame, pred: str, true: str, by: Sequence[str] = ()) -> DataFrame:
    """sqrt(sum (t-p)^2) / sqrt(sum (t - mean t)^2); the denominator is n * var_pop(t)."""
    e = F.col(true) - F.col(pred)
    return df.groupBy(*by).agg(
        F.try_divide(F.sqrt(F.sum(e * e)), F.sqrt(F.var_pop(true) * F.count(true))).alias("rse"))


def corr_ref(df: DataFrame, pred: str, true: str, channel: str, by: Sequence[str] = ()) -> DataFrame:
    """The reference's CORR: per channel sum(t~ p~) / sqrt(sum(t~^2 p~^2)), then mean over channels;
    Pearson ``corr`` per channel averaged the same way as a second column."""
    keys = [*by, channel]
    means = df.groupBy(*keys).agg(F.avg(true).alias("_mt"), F.avg(pred).alias("_mp"))
    d = df.join(means, on=keys)
    tt, pp = F.col(true) - F.col("_mt"), F.col(pred) - F.col("_mp")
    per = d.groupBy(*keys).agg(F.try_divide(F.sum(tt * pp), F.sqrt(F.sum(tt * tt * pp * pp))).alias("_c"),
                               F.corr(pred, true).alias("_pc"))
    return per.groupBy(*by).agg(F.avg("_c").alias("corr"), F.avg("_pc").alias("pearson"))


def mase_scale(insample: DataFrame, keys: Sequence[str], value: str, freq: int | str, pos: str = "pos",
               name: str = "masep", freqs: Sequence[int] = (), block: int = 4096) -> DataFrame:
    """Per series mean |x[i] - x[i-freq]| (the seasonal naive in-sample error).

    ``freq`` is a number, or a column with each series' frequency, whose possible values
    ``freqs`` lists.  The lag runs per (series, block) over rows that are copied into the next
    block where it reaches back, so there is no self-join and a long series spreads over many tasks.
    """
    keys = list(keys)
    lags = [freq] if isinstance(freq, int) else list(freqs)
    reach = max(lags)
    if block < reach:
        raise ValueError("block must be at least the longest lag")
    p, of = F.col(pos), (F.lit(freq) if isinstance(freq, int) else F.col(freq))
    own = F.floor(p / block).cast("bigint")
    src = insample.select(*keys, p.cast("bigint").alias("_p"), F.col(value).alias("_v"), of.alias("_f"),
                          F.explode(F.sequence(own, F.floor((p + reach) / block).cast("bigint"))).alias("_blk"))
    w = Window.partitionBy(*keys, "_blk").orderBy("_p")
    back = None
    for k in lags:
        back = F.lag("_v", k).over(w) if back is None else F.when(F.col("_f") == k, F.lag("_v", k).over(w)).otherwise(back)
    d = src.select(*keys, "_p", "_v", "_blk", back.alias("_w")).where(F.floor(F.col("_p") / block) == F.col("_blk"))
    return d.groupBy(*keys).agg(F.avg(F.abs(F.col("_v") - F.col("_w"))).alias(name))


def mase_scale_array(x: str, freq: int) -> Column:
    """The same scale for a window held as an array (0 where it has no pair)."""
    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - freq), F.slice(x, F.lit(freq + 1), F.size(x) - freq), lambda a, b: F.abs(b - a))
    return F.coalesce(F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v), F.size(pairs)), F.lit(0.0))


def mase_loss_agg(pred, true, mask, masep, name: str = "mase_loss") -> Column:
    """mean(|t - f| * divide_no_nan(mask, masep)) over all cells."""
    p, t, m, s = _c(pred), _c(true), _c(mask), _c(masep)
    return F.avg(F.abs(t - p) * divide_no_nan(m, s)).alias(name)


def batched_metrics(df: DataFrame, batch: str, aggs: list[Column], by: Sequence[str] = (),
                    overall: list[Column] = ()) -> DataFrame:
    """Two-level metric: each aggregate per batch, then the plain mean over batches.

    ``overall`` are aggregates over all rows (the value over the whole set, which differs from
    the batch mean where batches differ in size); they come out beside the means.
    """
    per = df.groupBy(*by, batch).agg(*aggs)
    names = [c for c in per.columns if c not in (*by, batch)]
    out = per.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names], F.count(F.lit(1)).alias("n_batches"))
    return out.join(df.groupBy(*by).agg(*overall), on=list(by)) if overall else out


def accuracy(df: DataFrame, gt: str, pred: str, by: Sequence[str] = (), name: str = "accuracy") -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(gt) == F.col(pred)).cast("double")).alias(name))


def mape_abs(pred, true, name: str = "mape_abs") -> Column:
    """Mean of abs(e / (t + 1e-8)): the whole ratio inside the absolute value."""
    p, t = _c(pred), _c(true)
    return F.avg(F.abs((p - t) / (t + F.lit(EPS)))).alias(name)


SKETCH = 100_000  # accuracy of the bracket sketch: it keeps about this many values per task


def error_quantiles(df: DataFrame, value: str, qs: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """Exact linear-interpolated quantiles (``describe()``) of a column, as one row.

    A sketch (bounded, one partial per task) brackets each quantile; one aggregate counts the
    values below the brackets; only values inside a bracket, about ``4 / SKETCH`` of all rows, are
    then counted per distinct value and ranked.  Nothing holds all values, and the sketch
    decides only how much is ranked, never the result.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    names = [f"q{int(round(q * 100))}" for q in qs]
    ends = [p for q in qs for p in (max(0.0, q - 2 / SKETCH), min(1.0, q + 2 / SKETCH))]
    brackets = v.agg(F.percentile_approx("v", ends, SKETCH).alias("p"))
    one = brackets.withColumn("_k", F.lit(1))

    def bracketed(d: DataFrame) -> DataFrame:  # one row of 2 * len(qs) numbers
        return d.withColumn("_k", F.lit(1)).join(F.broadcast(one), on="_k").drop("_k")

    lo, hi = (lambda i: F.col("p")[2 * i]), (lambda i: F.col("p")[2 * i + 1])
    whole = bracketed(v).agg(F.count(F.lit(1)).alias("n"), *(x for i in range(len(qs)) for x in (
        F.count(F.when(F.col("v") < lo(i), 1)).alias(f"below{i}"), F.max(F.when(F.col("v") < lo(i), F.col("v"))).alias(f"prev{i}"),
        F.min(F.when(F.col("v") > hi(i), F.col("v"))).alias(f"next{i}"))))
    near = F.array(*(F.struct(F.lit(i).alias("i"), lo(i).alias("lo"), hi(i).alias("hi")) for i in range(len(qs))))
    inside = bracketed(v).select("v", F.explode(F.filter(near, lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))).alias("b"))
    counts = inside.groupBy(F.col("b.i").alias("i"), "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("_k", F.lit(1)).join(
        F.broadcast(whole.withColumn("_k", F.lit(1))), on="_k")
    picks = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("n") - 1)
        for j, rank in enumerate((F.floor(at) + 1, F.ceil(at) + 1)):  # 1-based ranks on both sides
            inside_rank = rank - F.col(f"below{i}")
            here = (F.col("i") == i) & (F.col("upto") >= inside_rank) & (F.col("upto") - F.col("c") < inside_rank)
            picks += [F.max(F.when(here, F.col("v"))).alias(f"v{i}{j}"), F.max(F.when(rank <= F.col(f"below{i}"), F.col(f"prev{i}"))).alias(f"p{i}{j}"),
                      F.max(F.col(f"next{i}")).alias(f"x{i}{j}")]
        picks.append(F.max(at - F.floor(at)).alias(f"f{i}"))
    got = ranked.agg(*picks)
    side = lambda i, j: F.coalesce(f"p{i}{j}", f"v{i}{j}", f"x{i}{j}")
    return got.select(*((side(i, 0) + (side(i, 1) - side(i, 0)) * F.col(f"f{i}")).alias(n) for i, n in enumerate(names)))
