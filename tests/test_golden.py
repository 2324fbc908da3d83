"""Hand-computed goldens (the reference prints these cases without asserting them)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsflow.functions.calendar import features_for_freq
from tsflow.operators import metrics as M
from tsflow.operators import series as S
from tsflow.operators.m4 import m4_owa, m4_regroup
from tsflow.operators.windows import cut_windows, patch_count, patches, to_arrays


def test_masked_metric_bundle(spark):
    # pred 1, truth 2, shape 2x5, mask 1111011100
    mask = [1, 1, 1, 1, 0, 1, 1, 1, 0, 0]
    df = spark.createDataFrame([(i, 1.0, 2.0, float(m)) for i, m in enumerate(mask)], "i int, p double, t double, m double")
    r = df.agg(M.smape_loss_agg("p", "t", "m"), *M.eps_aggs("p", "t", "m")).first()
    assert r["smape_loss"] / 200 == pytest.approx(0.233333, abs=1e-6)
    assert r["mse"] == pytest.approx(1.0) and r["mae"] == pytest.approx(1.0) and r["rmse"] == pytest.approx(1.0)
    assert r["mape"] == pytest.approx(0.5, abs=1e-6)
    assert r["mspe"] == pytest.approx(0.175, abs=1e-6)   # mean over all 10 cells, not the 7 masked


def test_masked_cut_edge_case(spark):
    # sequence 1..10, L=8, label=7, pred=5, cut=6
    rows = spark.createDataFrame([(1, p, float(p + 1)) for p in range(10)], "k int, pos long, v double")
    cuts = spark.createDataFrame([(1, 10, 6)], "k int, n long, cut long")
    long = cut_windows(rows, cuts, ["k"], "v", "masked", 8, 7, 5)
    arr = {r["part"]: r for r in to_arrays(long, ["k"]).collect()}
    assert arr["x"]["value"] == [0, 0, 1, 2, 3, 4, 5, 6]
    assert arr["x"]["mask"] == [0, 0, 1, 1, 1, 1, 1, 1]
    assert arr["y"]["value"] == [2, 3, 4, 5, 6, 7, 8, 9, 10, 0, 0, 0]
    assert arr["y"]["mask"] == [1] * 9 + [0] * 3


def test_cut_align_option(spark):
    rows = spark.createDataFrame([(1, p, float(p + 1)) for p in range(10)], "k int, pos long, v double")
    cuts = spark.createDataFrame([(1, 10, 6)], "k int, n long, cut long")
    long = cut_windows(rows, cuts, ["k"], "v", "masked", 8, 7, 5, align="cut")
    y = {r["part"]: r for r in to_arrays(long, ["k"]).collect()}["y"]
    # slot = pos - (cut - label): pos -1 is a pad, pos 0..9 follow
    assert y["value"] == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0]


def test_patches(spark):
    df = spark.createDataFrame([([float(i) for i in range(18)],)], "x array<double>")
    p = df.select(patches(F.col("x"), 18, 8, 4).alias("p")).first()["p"]
    assert patch_count(18, 8, 4) == 4 and len(p) == 4
    assert p[0] == [0, 1, 2, 3, 4, 5, 6, 7]
    assert p[-1] == [12, 13, 14, 15, 16, 17, 17, 17]


def test_frequency_dispatch():
    assert features_for_freq("h") == ["hour_of_day", "day_of_week", "day_of_month", "day_of_year"]
    assert features_for_freq("15min")[0] == "minute_of_hour"
    assert features_for_freq("3H") == features_for_freq("h")
    assert features_for_freq("W-SUN") == ["day_of_month", "week_of_year"]
    assert features_for_freq("Y") == []
    with pytest.raises(ValueError):
        features_for_freq("5ms")
    with pytest.raises(ValueError):
        features_for_freq("fortnight")


def _adjust_loop(gt, pred):
    """Straightforward statement of point adjustment: a hit in a run of gt=1 flags the
    run; position 0 is never back-filled."""
    pred = list(pred)
    n = len(gt)
    i = 0
    while i < n:
        if gt[i] == 1:
            j = i
            while j < n and gt[j] == 1:
                j += 1
            hits = [k for k in range(i, j) if pred[k] == 1]
            if hits:
                for k in range(i, j):
                    if k >= hits[0] or k > 0:
                        pred[k] = 1
            i = j
        else:
            i += 1
    return pred


def test_point_adjust_random(spark):
    rng = np.random.default_rng(7)
    rows, expect = [], {}
    for s in range(60):
        n = int(rng.integers(1, 30))
        gt = rng.integers(0, 2, n).tolist()
        pr = rng.integers(0, 2, n).tolist()
        expect[s] = _adjust_loop(gt, pr)
        rows += [(s, i, gt[i], pr[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "s int, pos long, gt int, pred int")
    out = S.point_adjust(df, ["s"], "gt", "pred", block=4).collect()
    got = {}
    for r in out:
        got.setdefault(r["s"], {})[r["pos"]] = r["pred_adj"]
    for s, e in expect.items():
        assert [got[s][i] for i in range(len(e))] == e, s


def test_moving_avg_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=40)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "s int, pos long, v double")
    got = [r["trend"] for r in S.moving_avg(df, ["s"], "v", 7).orderBy("pos").collect()]
    padded = np.concatenate([np.repeat(x[0], 3), x, np.repeat(x[-1], 3)])
    ref = np.convolve(padded, np.ones(7) / 7, mode="valid")
    assert np.allclose(got, ref, atol=1e-12)
    halo = [r["trend"] for r in S.moving_avg(df, ["s"], "v", 7, block=8).orderBy("pos").collect()]
    assert np.allclose(halo, ref, atol=1e-12)
    with pytest.raises(ValueError):
        S.moving_avg(df, ["s"], "v", 4)


def test_autocorr_matches_fft_and_lags(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=16)
    df = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
    r = df.select(S.autocorr(F.col("x"), 16).alias("r")).first()["r"]
    ref = np.fft.irfft(np.abs(np.fft.rfft(x)) ** 2, n=16)
    assert np.allclose(r, ref, atol=1e-9)
    assert int(np.argmax(r)) == 0
    lags = df.select(S.top_lags(S.autocorr(F.col("x"), 16), 3).alias("l")).first()["l"]
    assert lags[0] == 0
    # r is symmetric: r[k] == r[16-k]; ties are ordered smaller lag first
    assert lags[1] < lags[2] and lags[1] + lags[2] == 16


def test_align_len(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0]), ([1.0], [5.0, 6.0])], "a array<double>, b array<double>")
    out = [r[0] for r in df.select(S.align_len(F.col("a"), F.col("b"))).collect()]
    assert out == [[4.0, 0.0, 0.0], [5.0]]


def test_m4_regroup_and_owa(spark):
    sc = spark.createDataFrame(
        [("A", 10.0, 1.0, 1.0, 2), ("B", 20.0, 2.0, 2.0, 2), ("C", 30.0, 3.0, 3.0, 1), ("D", 40.0, 4.0, 4.0, 3)],
        "grp string, smape double, mape double, mase double, n_series long")
    r = {x["grp"]: x for x in m4_regroup(sc, ["A", "B"], ["smape", "mape", "mase"]).collect()}
    assert r["A"]["smape"] == pytest.approx(10.0)
    assert r["Others"]["smape"] == pytest.approx((30 * 1 + 40 * 3) / 4)
    assert r["Average"]["smape"] == pytest.approx((10 * 2 + 20 * 2 + 30 + 40 * 3) / 8)
    base = sc.select("grp", (F.col("smape") * 2).alias("smape"), "mape", (F.col("mase") * 4).alias("mase"), "n_series")
    both = sc.withColumn("forecast", F.lit("m")).unionByName(base.withColumn("forecast", F.lit("b")))
    o = {x["grp"]: x["owa"] for x in m4_owa(m4_regroup(both, ["A", "B"], ["smape", "mape", "mase"], by=["forecast"]), "m", "b").collect()}
    assert o["A"] == pytest.approx(round((0.25 + 0.5) / 2, 3))


def test_divide_no_nan(spark):
    from tsflow.functions.core import divide_no_nan
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (float("inf"), 1.0)], "a double, b double")
    got = [r[0] for r in df.select(divide_no_nan(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 0.0, 1.5, 0.0]


def test_sincos(spark):
    from tsflow.functions.calendar import sincos
    df = spark.createDataFrame([(5,)], "p int")
    v = df.select(sincos(F.col("p"), 8).alias("v")).first()["v"]
    ref = []
    for j in range(8):
        f = math.exp(-(j - j % 2) * math.log(10000.0) / 8)
        ref.append(math.sin(5 * f) if j % 2 == 0 else math.cos(5 * f))
    assert np.allclose(v, ref)


def test_prompt_bank_lookup(spark, tmp_path):
    from tsflow.sources.readers import read_prompt_bank, with_content
    (tmp_path / "ETT.txt").write_text("ett text\nline two")
    (tmp_path / "Weather.txt").write_text("weather text")
    bank = read_prompt_bank(spark, str(tmp_path))
    df = spark.createDataFrame([("ETTh1",), ("ETTm2",), ("Weather",), ("Other",)], "data string")
    got = {r["data"]: r["content"] for r in with_content(df, bank, "data").collect()}
    assert got == {"ETTh1": "ett text\nline two", "ETTm2": "ett text\nline two", "Weather": "weather text",
                   "Other": None}


def test_period_agg_and_shared_lags(spark):
    rng = np.random.default_rng(5)
    rows = [(i // 3, i, [float(v) for v in rng.normal(size=12)]) for i in range(9)]
    df = spark.createDataFrame(rows, "b int, i int, x array<double>").withColumn("r", S.autocorr(F.col("x"), 12))
    out = S.period_agg(df, "x", 12, 1.0, r="r", name="p").select("i", "x", "p").collect()
    for row in out:
        x = np.array(row["x"])
        r = np.fft.irfft(np.abs(np.fft.rfft(x)) ** 2, n=12)
        k = int(math.log(12))
        lags = sorted(range(12), key=lambda j: (-round(r[j], 9), j))[:k]
        w = np.exp(r[lags] - r[lags].max())
        w = w / w.sum()
        ref = sum(w[m] * np.roll(x, -lags[m]) for m in range(k))
        assert np.allclose(row["p"], ref, atol=1e-9)
    sh = S.shared_lag_corr(df, "b", "r", 12).select("b", S.top_lags(F.col("r_batch"), 3).alias("l")).collect()
    by = {}
    for r in sh:
        by.setdefault(r["b"], set()).add(tuple(r["l"]))
    assert all(len(v) == 1 for v in by.values())


def test_autocorr_matches_the_sum_at_every_length(spark):
    rng = np.random.default_rng(9)
    for length in (1, 16, 17, 300):
        xs = [[float(v) for v in rng.normal(size=length)] for _ in range(5)]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x array<double>")
        for r in df.select("i", S.autocorr(F.col("x"), length).alias("r")).collect():
            x = np.array(xs[r["i"]])
            assert np.allclose(r["r"], [np.dot(x, np.roll(x, -k)) for k in range(length)], atol=1e-8)


@pytest.mark.parametrize("mode,seq,label,pred,cut,x,xm,y,ym", [
    # M4 window: x right-aligned, y from cut-label left-aligned with a right pad
    ("m4", 6, 3, 3, 8, [3, 4, 5, 6, 7, 8], [1] * 6, [6, 7, 8, 9, 10, 0], [1, 1, 1, 1, 1, 0]),
    # window from the cycle start: x = first seq values (mask 0), y masked
    ("head", 4, 2, 5, 4, [1, 2, 3, 4], [0] * 4, [3, 4, 5, 6, 7, 8, 9], [1] * 7),
    # plain cut window: masks all 0
    ("cut", 4, 2, 3, 5, [2, 3, 4, 5], [0] * 4, [4, 5, 6, 7, 8], [0] * 5),
])
def test_window_modes_small_case(spark, mode, seq, label, pred, cut, x, xm, y, ym):
    rows = spark.createDataFrame([(1, p, float(p + 1)) for p in range(10)], "k int, pos long, v double")
    cuts = spark.createDataFrame([(1, 10, cut)], "k int, n long, cut long")
    arr = {r["part"]: r for r in to_arrays(cut_windows(rows, cuts, ["k"], "v", mode, seq, label, pred), ["k"]).collect()}
    assert arr["x"]["value"] == x and arr["x"]["mask"] == xm
    assert arr["y"]["value"] == y and arr["y"]["mask"] == ym


def test_window_rejects_and_histogram(spark):
    from tsflow.operators.windows import length_histogram, window_rejects
    lens = spark.createDataFrame([(1, 40), (2, 49), (3, 49), (4, 80)], "k int, n long")
    rej = {r["k"]: (r["low"], r["high"]) for r in window_rejects(lens, ["k"], "cut", 18, 30).collect()}
    assert rej == {1: (18, 10)}   # low >= high only for n = 40 (n = 49 leaves [18, 19))
    h = {r["len"]: r["n_series"] for r in length_histogram(lens).collect()}
    assert h == {40: 1, 49: 2, 80: 1}
