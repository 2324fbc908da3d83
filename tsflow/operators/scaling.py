"""Standard scaling (fit on train rows only) and per-window instance normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """One-row table ``mean_<c>, std_<c>``: mean and population std, std 0 -> 1.

    All channels in one aggregate pass (partial aggregation on every task).
    """
    src = df.where(where) if where is not None else df
    aggs = []
    for c in cols:
        aggs.append(F.avg(F.col(c)).alias(f"mean_{c}"))
        aggs.append(F.stddev_pop(F.col(c)).alias(f"_sd_{c}"))
    s = src.agg(*aggs)
    return s.select(*[F.col(f"mean_{c}") for c in cols],
                    *[F.when(F.col(f"_sd_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_sd_{c}")).alias(f"std_{c}")
                      for c in cols])


def fit_scaler_long(df: DataFrame, channel: str, value: str, where: Column | None = None) -> DataFrame:
    """Long form: one row per channel ``(channel, mean, std)``."""
    src = df.where(where) if where is not None else df
    s = src.groupBy(channel).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_sd"))
    return s.select(channel, "mean", F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd")).alias("std"))


def _attach(df: DataFrame, scaler: DataFrame) -> DataFrame:
    # the scaler is a single row: equi-join on a constant key with a broadcast (size 1)
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(scaler.withColumn("_k", F.lit(1))), on="_k").drop("_k")


def scale(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    j = _attach(df, scaler)
    for c in cols:
        j = j.withColumn(c, (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}"))
    return j.drop(*[f"mean_{c}" for c in cols], *[f"std_{c}" for c in cols])


def unscale(df: DataFrame, scaler: DataFrame, cols: Sequence[str]) -> DataFrame:
    j = _attach(df, scaler)
    for c in cols:
        j = j.withColumn(c, F.col(c) * F.col(f"std_{c}") + F.col(f"mean_{c}"))
    return j.drop(*[f"mean_{c}" for c in cols], *[f"std_{c}" for c in cols])


def scale_long(df: DataFrame, scaler: DataFrame, channel: str, value: str, inverse: bool = False) -> DataFrame:
    """Long form: join the per-channel table (Spark broadcasts it where it is small)."""
    j = df.join(scaler, on=channel)
    v = F.col(value) * F.col("std") + F.col("mean") if inverse else (F.col(value) - F.col("mean")) / F.col("std")
    return j.withColumn(value, v).drop("mean", "std")


# ---------------------------------------------------------------- instance norm (RevIN)
def revin_stats(x_long: DataFrame, window_keys: Sequence[str], value: str = "value", step: str = "step",
                seq: int | None = None, eps: float = 1e-5) -> DataFrame:
    """Per-window statistics over all x slots: mean, last, stdev = sqrt(var_pop + eps).

    Windows are bounded (``seq`` slots), so a plain aggregate per window is cheap.
    """
    last = F.max_by(F.col(value), F.col(step))
    return x_long.groupBy(*window_keys).agg(
        F.avg(value).alias("rv_mean"), last.alias("rv_last"),
        F.sqrt(F.var_pop(value) + F.lit(eps)).alias("rv_std"))


def revin(x_long: DataFrame, window_keys: Sequence[str], value: str = "value", step: str = "step",
          eps: float = 1e-5, subtract_last: bool = False, affine: tuple[float, float] | None = None,
          non_norm: bool = False) -> DataFrame:
    """Normalise each window: (x - mean or last) / stdev [* w + b].  Keeps the stats columns."""
    w = Window.partitionBy(*window_keys)
    d = (x_long.withColumn("rv_mean", F.avg(value).over(w))
         .withColumn("rv_last", F.max_by(F.col(value), F.col(step)).over(w))
         .withColumn("rv_std", F.sqrt(F.var_pop(value).over(w) + F.lit(eps))))
    if non_norm:
        return d
    center = F.col("rv_last") if subtract_last else F.col("rv_mean")
    v = (F.col(value) - center) / F.col("rv_std")
    if affine is not None:
        v = v * F.lit(float(affine[0])) + F.lit(float(affine[1]))
    return d.withColumn(value, v)


def unrevin(df: DataFrame, value: str, eps: float = 1e-5, subtract_last: bool = False,
            affine: tuple[float, float] | None = None, non_norm: bool = False) -> DataFrame:
    """Inverse of ``revin`` using the kept ``rv_*`` columns; affine divisor is ``w + eps^2``."""
    if non_norm:
        return df
    v = F.col(value)
    if affine is not None:
        v = (v - F.lit(float(affine[1]))) / F.lit(float(affine[0]) + eps * eps)
    v = v * F.col("rv_std") + (F.col("rv_last") if subtract_last else F.col("rv_mean"))
    return df.withColumn(value, v)
