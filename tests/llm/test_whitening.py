import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsflow.llm import whitening as W
from tsflow.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"


def brute(rows, k=8):
    """{(id, component): (n, deviation, |whitened|, explained)} by numpy's own eigensolver on exact integers."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [int(sum((n * c - t) ** 2 for c, t in zip(row, s))) for row in x]
    d = (n * x - s).astype(float) / n
    e, v = np.linalg.eigh(d.T @ d / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    w = d @ v / np.sqrt(e)
    return {(i, c + 1): (n, deviation[r], abs(w[r, c]), e[c] / np.trace(d.T @ d / n)) for r, (i, _) in enumerate(kept) for c in range(len(e))}


def check(result, want):
    got = {(r.vec_id, r.component): r for r in result.collect()}
    assert got.keys() == want.keys()
    for key, (n, deviation, whitened, explained) in want.items():
        r = got[key]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened) == pytest.approx(whitened, abs=1e-7) and r.explained == pytest.approx(explained, rel=1e-8)
        assert r.identity_error < 1e-8
    return got


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 130])
def test_eigen_matches_numpy(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    a = a @ np.diag(10.0 ** rng.uniform(-6, 3, n)) @ a.T
    values, vectors = W.eigen(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-9, atol=1e-12 * np.linalg.norm(a))
    assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * values) < 1e-12 * np.linalg.norm(a)


@pytest.mark.parametrize("spectrum", [[1, 1, 1, 1], [5, 5, 2, 2, 2, 0, 0], [1, 0, 0, 0], [3, -3, 3, -3], [0, 0, 0], [1, 1 + 1e-13, 1 + 1e-9], [1e12, 1, 1, 1e-9]])
def test_eigen_of_repeated_and_zero_values(spectrum):
    n = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(3).normal(size=(n, n)))
    for basis in (q, np.eye(n)):
        a = basis @ np.diag(np.array(spectrum, float)) @ basis.T
        values, vectors = W.eigen(a)
        scale = max(np.linalg.norm(a), 1e-300)
        assert np.allclose(values, sorted(spectrum, reverse=True), atol=1e-12 * scale)
        assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-12 * scale
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)


def test_embeddings_match_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got = check(QUERIES["op12_whitening"](spark, SF001), brute(rows))
    # either sign, but the same for all rows
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in rows], float)
    d = x - x.mean(0)
    e, v = np.linalg.eigh(d.T @ d / len(d))
    for c in range(1, 9):
        mine = np.array([got[i, c].whitened for i, _ in rows])
        want = d @ v[:, -c] / np.sqrt(e[-c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7


def test_left_out_rows_ties_and_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [1.0, 2.0, math.inf, 3.0, 4.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(4)
    df = df.withColumns({c: F.lit("mine") for c in ("id", "v", "part", "cells", "salt", "component", "n", "whitened", "d")})
    check(W.whiten(df), brute(rows))
    twice = W.whiten(df.union(df).union(df.where("vec_id = 3").withColumn("vec_id", F.lit(None).cast("long")))).collect()
    assert {r.n for r in twice} == {81} and sum(r.vec_id is None for r in twice) == 5


def test_no_variance_and_empty(spark):
    one = W.whiten(spark.createDataFrame([(1, [0.5, 0.25])], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    flat = W.whiten(spark.createDataFrame([(i, [float(i % 7), 3.0, float(i % 7)]) for i in range(70)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in flat)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert W.whiten(none).collect() == [] and W.whiten(none).columns == W.whiten(spark.createDataFrame([(1, None)], none.schema)).columns


def test_deviation_beyond_machine_words():
    x = np.array([[2 ** 40, 0], [1, 5]])
    assert W._distance(x, 2, x.sum(0)).to_pylist() == [None, None]
    y = np.array([[2 ** 30 + 1, 0], [1, 5]])
    assert W._distance(y, 2, y.sum(0)).to_pylist() == [2 ** 60 + 25] * 2
