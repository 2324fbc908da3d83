"""M4-style competition scoring: sMAPE, MAPE, MASE per group, regrouping and OWA.

Forecast / actual / in-sample tables are long: ``(id, step, value)``; one
``groupBy(grp)`` over an (id, step) join replaces the per-group loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsflow.operators.metrics import mase_scale


def smape_point(f: Column, t: Column) -> Column:
    denom = F.abs(t) + F.abs(f)
    return F.lit(200.0) * F.abs(f - t) / F.when(denom == 0, F.lit(1.0)).otherwise(denom)


def mape_point(f: Column, t: Column) -> Column:
    denom = F.abs(t)
    return F.lit(100.0) * F.abs(f - t) / F.when(denom == 0, F.lit(1.0)).otherwise(denom)


def m4_series(info: DataFrame, values: DataFrame, group: str | None = None, id_col: str = "id",
              grp: str = "grp") -> DataFrame:
    """Info joined to long values on id; NaN / null tail removed; optional group selection."""
    v = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    d = v.join(info, on=id_col)
    if group is not None:
        d = d.where(F.col(grp) == group)
    return d


def m4_scores(fc: DataFrame, actual: DataFrame, insample: DataFrame, info: DataFrame, freqs: Sequence[int],
              fc_cols: Sequence[str] = ("yhat",), id_col: str = "id", grp: str = "grp", freq: str = "freq",
              y_col: str = "y") -> DataFrame:
    """Per group: sMAPE and MAPE as means over points, MASE as the mean over series.

    ``fc``: (id, step, one column per forecast in ``fc_cols``); ``actual``: (id, step, y); ``insample``:
    (id, pos, value); ``info``: (id, grp, freq): each group has its own frequency, one of ``freqs``.
    All forecasts are scored in one pass over one (id, step) join.  One row per group and forecast:
    (grp, forecast, smape, mape, mase, n_series, n_missing).  A forecast missing for a point gives
    null (and is counted) instead of reusing another group's; a series too short for its
    frequency has a null MASE.
    """
    pts = actual.join(fc, on=[id_col, "step"], how="left")
    t = F.col(y_col)
    sums = [F.count(F.lit(1)).alias("_nt")]
    for c in fc_cols:
        f = F.col(c)
        sums += [F.avg(F.abs(f - t)).alias(f"_mae_{c}"), F.sum(smape_point(f, t)).alias(f"_s_{c}"),
                 F.sum(mape_point(f, t)).alias(f"_m_{c}"), F.count(f).alias(f"_np_{c}")]
    per_series = pts.groupBy(id_col).agg(*sums).join(info.select(id_col, grp, freq), on=id_col)
    sc = mase_scale(insample.join(info.select(id_col, freq), on=id_col), [id_col], "value", freq, freqs=freqs)
    per_series = per_series.join(sc, on=id_col, how="left")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("forecast"), F.col(f"_mae_{c}").alias("mae"), F.col(f"_s_{c}").alias("s"),
                                        F.col(f"_m_{c}").alias("m"), F.col(f"_np_{c}").alias("np")) for c in fc_cols)))
    long = per_series.select(grp, "_nt", "masep", each.alias("e")).select(grp, "_nt", "masep", "e.*")
    return long.groupBy(grp, "forecast").agg(
        F.try_divide(F.sum("s"), F.sum("np")).alias("smape"), F.try_divide(F.sum("m"), F.sum("np")).alias("mape"),
        F.avg(F.try_divide(F.col("mae"), F.col("masep"))).alias("mase"), F.count(F.lit(1)).alias("n_series"),
        (F.sum("_nt") - F.sum("np")).alias("n_missing"))


def m4_regroup(scores: DataFrame, main_groups: Sequence[str], metrics: Sequence[str],
               grp: str = "grp", count: str = "n_series", others: str = "Others",
               average: str = "Average", by: Sequence[str] = ()) -> DataFrame:
    """Main groups kept; the rest become one count-weighted ``Others`` row; ``Average`` is the
    count-weighted mean over everything.  One pass: each row counts for its coarse group and for
    the average (per ``by``, e.g. the forecast's name)."""
    coarse = F.when(F.col(grp).isin(list(main_groups)), F.col(grp)).otherwise(F.lit(others))
    d = scores.withColumn("_coarse", F.explode(F.array(coarse, F.lit(average))))
    aggs = [(F.sum(F.col(m) * F.col(count)) / F.sum(F.when(F.col(m).isNotNull(), F.col(count)))).alias(m) for m in metrics]
    r = d.groupBy(*by, "_coarse").agg(*aggs, F.sum(count).alias(count))
    return r.select(F.col("_coarse").alias(grp), *by, *metrics, count)


def m4_owa(scores: DataFrame, model: str, base: str, grp: str = "grp") -> DataFrame:
    """OWA = (MASE / MASE_base + sMAPE / sMAPE_base) / 2 per group; every score rounded
    half-even to 3 decimals (numpy ``round``).  ``scores`` has a row per (group, forecast)."""
    of = lambda m, who: F.max(F.when(F.col("forecast") == who, F.col(m))).alias(f"{m}_{who}")
    j = scores.groupBy(grp).agg(*(of(m, w) for m in ("smape", "mape", "mase") for w in (model, base)))
    ratio = lambda m: F.try_divide(F.col(f"{m}_{model}"), F.col(f"{m}_{base}"))
    owa = (ratio("mase") + ratio("smape")) / 2
    return j.select(grp, *(F.bround(f"{m}_{model}", 3).alias(m) for m in ("smape", "mape", "mase")), F.bround(owa, 3).alias("owa"))
