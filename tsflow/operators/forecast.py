"""Data-parallel forecasters and the pluggable batch-scoring surface.

* ``forecast_mean``   -- uniform-weight linear model: the window mean repeated over the horizon.
* ``fit_linear``      -- least-squares linear map x -> horizon (same function class as a
  seasonal+trend linear model, since trend = M x and seasonal = x - M x).  Gram partials
  are built per Arrow batch inside the tasks, summed by Spark, and solved in tasks, one
  (L+1) x (L+1+pred) system per group; nothing passes through the driver.
* ``forecast_linear`` -- one matrix product per Arrow batch and group.
* ``score_windows``   -- any Python predictor over Arrow batches (``mapInPandas``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def forecast_drift(x: Column, pred: int) -> Column:
    """Last value plus the mean step of the window times the horizon step (1, 2, ...)."""
    slope = (F.element_at(x, -1) - F.element_at(x, 1)) / (F.size(x) - 1)
    return F.transform(F.sequence(F.lit(1), F.lit(pred)), lambda h: F.element_at(x, -1) + slope * h)


def forecast_mean(x: Column, pred: int) -> Column:
    """Window mean (over all ``x`` slots) repeated ``pred`` times."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)
    return F.array_repeat(mean, pred)


def _gram_partials(x_col: str, y_col: str, by: Sequence[str], L: int, P: int):
    def fn(it):
        acc: dict = {}
        for pdf in it:
            if pdf.empty:
                continue
            groups = pdf.groupby(list(by), sort=False) if by else [((), pdf)]
            for key, g in groups:
                X = np.vstack(g[x_col].to_numpy())
                Y = np.vstack(g[y_col].to_numpy())
                X = np.hstack([X, np.ones((X.shape[0], 1))])
                k = key if isinstance(key, tuple) else (key,)
                xtx, xty = X.T @ X, X.T @ Y
                if k in acc:
                    acc[k][0] += xtx
                    acc[k][1] += xty
                else:
                    acc[k] = [xtx, xty]
        rows = []
        for k, (xtx, xty) in acc.items():
            flat = np.concatenate([xtx.ravel(), xty.ravel()])
            rows.append(list(k) + [flat.tolist()])
        yield pd.DataFrame(rows, columns=[*by, "_gram"]) if rows else pd.DataFrame(columns=[*by, "_gram"])
    return fn


def fit_linear(windows: DataFrame, x: str, y: str, seq: int, pred: int, by: Sequence[str] = (),
               ridge: float = 0.0) -> DataFrame:
    """Least-squares coefficients per ``by`` group (``individual`` mode) or shared.

    Each task sums its windows' Gram matrices (one row per group and task); the sums meet per
    group, rows of the matrix apart, and each group's system is solved in a task of its own.
    Returns ``(by..., coef ARRAY<DOUBLE>)`` with coef laid out as (seq + 1) rows x pred columns (last
    row = bias, which ``ridge`` does not penalise).
    """
    by = list(by)
    L, P = seq, pred
    keys = [windows.schema[b] for b in by]
    schema = T.StructType([*keys, T.StructField("_gram", T.ArrayType(T.DoubleType()))])
    parts = windows.select(*by, x, y).mapInPandas(_gram_partials(x, y, by, L, P), schema=schema)
    # one matrix row per (group, i): a partial sum per position, then one bounded array per group
    width = L + 1 + P
    cells = parts.select(*by, F.posexplode("_gram").alias("_i", "_v")).groupBy(*by, "_i").agg(F.sum("_v").alias("_v"))
    systems = cells.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_s"))
    out = T.StructType([*keys, T.StructField("coef", T.ArrayType(T.DoubleType()))])

    def solve(it):
        for pdf in it:
            coefs = []
            for cells_of in pdf["_g"]:
                flat = np.asarray(cells_of, dtype=float)
                assert flat.size == (L + 1) * width
                xtx = flat[: (L + 1) ** 2].reshape(L + 1, L + 1)
                xty = flat[(L + 1) ** 2:].reshape(L + 1, P)
                penalty = ridge * np.eye(L + 1)
                penalty[L, L] = 0.0
                coefs.append(np.linalg.lstsq(xtx + penalty, xty, rcond=None)[0].ravel().tolist())
            res = pdf[by].copy()
            res["coef"] = coefs
            yield res

    return systems.select(*by, F.transform("_s", lambda e: e["_v"]).alias("_g")).mapInPandas(solve, schema=out)


def forecast_linear(windows: DataFrame, coef: DataFrame, x: str, seq: int, pred: int, by: Sequence[str] = (),
                    name: str = "yhat") -> DataFrame:
    """``yhat = [x, 1] @ W``: windows meet their group's coefficients in an equi-join (Spark broadcasts
    the coefficients where they are small), and each Arrow batch is one matrix product per group."""
    by = list(by)
    if by:
        d = windows.join(coef, on=by)
    else:  # one row
        d = windows.withColumn("_k", F.lit(1)).join(F.broadcast(coef.withColumn("_k", F.lit(1))), on="_k").drop("_k")
    schema = T.StructType([*(f for f in d.schema if f.name != "coef"), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def apply(it):
        for pdf in it:
            if pdf.empty:
                continue
            out = np.empty((len(pdf), pred))
            groups = pdf.groupby(by, sort=False).indices.values() if by else [np.arange(len(pdf))]
            for at in groups:
                W = np.asarray(pdf["coef"].iloc[at[0]], dtype=float).reshape(seq + 1, pred)
                out[at] = np.vstack(pdf[x].iloc[at].to_numpy()).astype(float) @ W[:seq] + W[seq]
            res = pdf.drop(columns="coef")
            res[name] = list(out)
            yield res

    return d.mapInPandas(apply, schema=schema)


def score_windows(windows: DataFrame, predict: Callable[..., np.ndarray], x: str, pred: int,
                  keys: Sequence[str], name: str = "yhat", inputs: Sequence[str] = ()) -> DataFrame:
    """Run a user predictor over Arrow batches: ``predict(X [B, L], *inputs) -> [B, pred]``.

    ``inputs`` are further array columns (time marks, masks, decoder input), each handed over as
    an array with the batch as its first axis.
    """
    keys = list(keys)
    schema = T.StructType([*[windows.schema[k] for k in keys],
                           T.StructField(name, T.ArrayType(T.DoubleType()))])

    def stack(column) -> np.ndarray:
        return np.stack([np.vstack(v) if len(v) and hasattr(v[0], "__len__") else np.asarray(v, dtype=float) for v in column]).astype(float)

    def fn(it):
        for pdf in it:
            if pdf.empty:
                continue
            Y = np.asarray(predict(*(stack(pdf[c]) for c in (x, *inputs))), dtype=float).reshape(len(pdf), pred)
            out = pdf[keys].copy()
            out[name] = list(Y)
            yield out
    return windows.select(*keys, x, *inputs).mapInPandas(fn, schema=schema)


def mean_predictor(pred: int) -> Callable[[np.ndarray], np.ndarray]:
    """The uniform-weight linear model as a Python predictor (same numbers as forecast_mean)."""
    def f(X: np.ndarray) -> np.ndarray:
        # sequential sum (cumsum), the same order as the JVM fold in forecast_mean
        return np.repeat(np.cumsum(X, axis=1)[:, -1:] / X.shape[1], pred, axis=1)
    return f


def with_revin(x_long: DataFrame, keys: Sequence[str], pred: int,
               forecaster: Callable[[Column, int], Column] = forecast_mean, value: str = "value",
               step: str = "step", eps: float = 1e-5, subtract_last: bool = False) -> DataFrame:
    """Normalise each window (RevIN), forecast on the normalised values, de-normalise.

    ``x_long``: window slots ``(keys, step, value)``; ``forecaster(x_array, pred)`` returns the
    horizon array.  Output ``(keys, h, yhat)``.
    """
    from tsflow.operators.scaling import revin, unrevin
    from tsflow.operators.windows import to_arrays
    keys = list(keys)
    x = revin(x_long, keys, value=value, step=step, eps=eps, subtract_last=subtract_last)
    stats = x.groupBy(*keys).agg(F.first("rv_mean").alias("rv_mean"), F.first("rv_std").alias("rv_std"),
                                 F.first("rv_last").alias("rv_last"))
    arr = to_arrays(x.withColumnRenamed(value, "_v"), keys, cols=("_v",), part=None)
    f = arr.select(*keys, forecaster(F.col("_v"), pred).alias("_f")).join(stats, on=keys)
    e = f.select(*keys, "rv_mean", "rv_std", "rv_last", F.posexplode("_f").alias("h", "yhat"))
    return unrevin(e, "yhat", eps=eps, subtract_last=subtract_last).select(
        *keys, F.col("h").cast("bigint").alias("h"), "yhat")
