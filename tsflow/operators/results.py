"""Result table (batch, seq, id, y, yhat) and the error analyses run on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsflow.operators.metrics import error_quantiles
from tsflow.session import materialize

RKEYS = ["batch", "seq"]


def result_rows(windows: DataFrame, keys: list[str], label: int, x: str = "x", y: str = "y", yhat: str = "yhat",
                x_mask: str | None = None, y_mask: str | None = None, history: bool = True) -> DataFrame:
    """Long result rows ``(keys, id, y, yhat, mask)`` from one row per window with arrays.

    Ids 0..seq-1 are history (y = yhat = x; left out without ``history``, where ids are horizon
    steps), then the horizon: y = truth at y slot label + h, yhat =
    forecast step h (null where the forecast is shorter).  Masks multiply history and truth and are
    kept as a column (1 without masks).  One explode per window: no join, no shuffle.
    """
    one = lambda a: F.transform(a, lambda v: F.lit(1.0))
    mx = F.col(x_mask) if x_mask else one(F.col(x))
    my = F.col(y_mask) if y_mask else one(F.col(y))
    past = F.transform(F.arrays_zip(F.col(x).alias("v"), mx.alias("m")),
                       lambda z: F.struct((z["v"] * z["m"]).alias("y"), (z["v"] * z["m"]).alias("yhat"), z["m"].alias("mask")))
    rest = F.size(y) - label
    ahead = F.transform(F.arrays_zip(F.slice(F.col(y), label + 1, rest).alias("v"), F.slice(my, label + 1, rest).alias("m"), F.col(yhat).alias("f")),
                        lambda z: F.struct((z["v"] * z["m"]).alias("y"), z["f"].alias("yhat"), z["m"].alias("mask")))
    rows = windows.select(*keys, F.posexplode(F.concat(past, ahead) if history else ahead).alias("id", "r"))
    return rows.select(*keys, F.col("id").cast("bigint").alias("id"), "r.y", "r.yhat", "r.mask")


def with_dif(df: DataFrame) -> DataFrame:
    return df.withColumn("dif", F.col("y") - F.col("yhat"))


def nonzero_predictions(df: DataFrame, digits: int = 3) -> DataFrame:
    """Rows where the forecast differs from the truth, forecast rounded half-even."""
    return with_dif(df).where(F.col("dif") != 0).select(*RKEYS, "id", F.bround("yhat", digits).alias("yhat_r"))


def _attach_one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    # one-row statistics: constant-key equi-join with a broadcast (size 1)
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(stats.withColumn("_k", F.lit(1))), on="_k").drop("_k")


def endpoint_error(df: DataFrame, at_id: int) -> DataFrame:
    """|dif| at one id per series, with the 25 / 75 % quantiles of that column."""
    e = materialize(with_dif(df).where(F.col("id") == at_id).select(*RKEYS, F.abs("dif").alias("abs_dif")))  # several readers
    return _attach_one_row(e, error_quantiles(e, "abs_dif"))


def process_error(df: DataFrame, from_id: int) -> DataFrame:
    """Mean dif over ids >= from_id per series, its abs, and quantiles of the signed means."""
    m = with_dif(df).where(F.col("id") >= from_id).groupBy(*RKEYS).agg(F.avg("dif").alias("mean_dif"))
    m = materialize(m.withColumn("abs_mean_dif", F.abs("mean_dif")))  # several readers
    return _attach_one_row(m, error_quantiles(m, "mean_dif"))


def series_rmse(df: DataFrame, from_id: int) -> DataFrame:
    d = with_dif(df).where(F.col("id") >= from_id)
    return d.groupBy(*RKEYS).agg(F.sqrt(F.avg(F.col("dif") * F.col("dif"))).alias("rmse"))


def tail_border(df: DataFrame, seq: int, offset: int = 3, extra: int = 2, fill: float = 1.95) -> DataFrame:
    """Plot segment of each masked series: ids in [seq - offset, border + extra), where border is the
    first horizon id whose mask is 0, or one past the last id of a series that fills its horizon.
    Every series stays; a real zero, or a left pad, ends nothing.  Masked cells show ``fill``.
    """
    off = (F.col("mask") == 0) & (F.col("id") >= seq)
    b = df.groupBy(*RKEYS).agg(F.coalesce(F.min(F.when(off, F.col("id"))), F.max("id") + 1).alias("border"))
    d = df.join(b, on=RKEYS).where((F.col("id") >= seq - offset) & (F.col("id") < F.col("border") + extra))
    return d.select(*RKEYS, "id", "border", F.when(F.col("mask") == 0, F.lit(fill)).otherwise(F.col("y")).alias("y_plot"),
                    "yhat")


def worst_series(rmse: DataFrame, k: int, worst: bool = True) -> DataFrame:
    """Top-k series by RMSE (ties by batch, seq) -- a bounded TakeOrderedAndProject."""
    o = [F.col("rmse").desc() if worst else F.col("rmse").asc(), F.col("batch"), F.col("seq")]
    return rmse.orderBy(*o).limit(k)
