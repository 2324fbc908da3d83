"""Properties of the operators (reference test strategy: round trips, coverage, brute force)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsflow.operators import forecast as fcst
from tsflow.operators.order import global_rank, with_position
from tsflow.operators.scaling import fit_scaler, revin, scale, unrevin, unscale
from tsflow.operators.splits import split_fixed, split_groups, split_ratio
from tsflow.operators.windows import explode_windows, sliding_windows


def _series(spark, n_series=3, n=50, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(s, p, float(rng.normal())) for s in range(n_series) for p in range(n + 7 * s)]
    return spark.createDataFrame(rows, "s int, pos long, v double")


def test_halo_blocks_equal_plain_frame(spark):
    df = _series(spark)
    plain = explode_windows(sliding_windows(df, ["s"], "v", 8, 4, 4), ["s"])
    halo = explode_windows(sliding_windows(df, ["s"], "v", 8, 4, 4, block=16), ["s"])
    assert plain.count() == halo.count() == sum((50 + 7 * s - 12 + 1) * 16 for s in range(3))
    assert plain.exceptAll(halo).count() == 0 and halo.exceptAll(plain).count() == 0


def test_window_count(spark):
    df = _series(spark, 1, 30)
    w = sliding_windows(df, ["s"], "v", 10, 5, 5)
    assert w.count() == 30 - 10 - 5 + 1
    r = w.orderBy("window_id").first()
    assert len(r["x"]) == 10 and len(r["y"]) == 10


def test_bucketed_position_equals_row_number(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(t), int(i)) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 1000, 300)))]
    df = spark.createDataFrame(rows, "k int, t long, i long")
    a = with_position(df, ["k"], ["t", "i"], bucket=F.floor(F.col("t") / 97))
    b = with_position(df, ["k"], ["t", "i"])
    assert a.exceptAll(b).count() == 0
    g = global_rank(df, ["t", "i"], bucket=F.floor(F.col("t") / 50), name="r")
    got = [r["i"] for r in g.orderBy("r").collect()]
    assert got == [i for _, _, i in sorted(rows, key=lambda x: (x[1], x[2]))]


def test_split_groups_disjoint_and_covering(spark):
    keys = spark.createDataFrame([(i, i % 7) for i in range(200)], "a int, b int")
    sg = split_groups(keys, ["a", "b"], seed=1)
    c = {r["split"]: r["count"] for r in sg.groupBy("split").count().collect()}
    assert c == {"train": 120, "val": 20, "test": 60}
    assert sg.select("a", "b").distinct().count() == 200
    assert sorted(r["rank"] for r in sg.collect()) == list(range(200))


def test_split_fixed_and_ratio_borders(spark):
    df = spark.range(100).withColumnRenamed("id", "pos")
    f = {r["split"]: (r["lo"], r["hi"], r["n"]) for r in split_fixed(df, "pos", 50, 70, 100, 10)
         .groupBy("split").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n")).collect()}
    assert f == {"train": (0, 49, 50), "val": (40, 69, 30), "test": (60, 99, 40)}
    r = {x["split"]: x["n"] for x in split_ratio(df, "pos", 10).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert r == {"train": 70, "val": 20, "test": 30}


def test_scaler_round_trip(spark):
    df = _series(spark).withColumn("w", F.col("v") * 3 + 1)
    sc = fit_scaler(df, ["v", "w"], where=F.col("pos") < 20)
    back = unscale(scale(df, sc, ["v", "w"]), sc, ["v", "w"])
    d = back.join(df.withColumnRenamed("v", "v0").withColumnRenamed("w", "w0"), ["s", "pos"])
    assert d.agg(F.max(F.abs(F.col("v") - F.col("v0"))), F.max(F.abs(F.col("w") - F.col("w0")))).first()[0] < 1e-12
    st = scale(df, sc, ["v"]).where(F.col("pos") < 20).agg(F.avg("v"), F.stddev_pop("v")).first()
    assert abs(st[0]) < 1e-12 and abs(st[1] - 1) < 1e-12


def test_revin_round_trip(spark):
    df = _series(spark).withColumnRenamed("pos", "step")
    for last in (False, True):
        n = revin(df.withColumn("v0", F.col("v")), ["s"], value="v", subtract_last=last, affine=(2.0, 0.5))
        b = unrevin(n, "v", subtract_last=last, affine=(2.0, 0.5))
        assert b.agg(F.max(F.abs(F.col("v") - F.col("v0")))).first()[0] < 1e-6


def test_fit_linear_matches_numpy(spark):
    rng = np.random.default_rng(11)
    L, P, N = 6, 3, 400
    X = rng.normal(size=(N, L))
    W = rng.normal(size=(L, P))
    Y = X @ W + 0.5 + 0.01 * rng.normal(size=(N, P))
    rows = [(i, X[i].tolist(), Y[i].tolist()) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>").repartition(5)
    coef = fcst.fit_linear(df, "x", "y", L, P)
    Xa = np.hstack([X, np.ones((N, 1))])
    ref, *_ = np.linalg.lstsq(Xa, Y, rcond=None)
    got = np.array(coef.first()["coef"]).reshape(L + 1, P)
    assert np.allclose(got, ref, atol=1e-8)
    fc = fcst.forecast_linear(df, coef, "x", L, P).orderBy("id").collect()
    assert np.allclose(np.array([r["yhat"] for r in fc]), Xa @ ref, atol=1e-8)
    # the fitted map beats the window-mean forecaster on its training data
    mean_err = float(np.mean((np.repeat(X.mean(1, keepdims=True), P, 1) - Y) ** 2))
    lin_err = float(np.mean((Xa @ ref - Y) ** 2))
    assert lin_err <= mean_err


def test_score_windows_mean_predictor(spark):
    rows = [(i, [float(i + j) for j in range(5)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    a = fcst.score_windows(df, fcst.mean_predictor(3), "x", 3, ["id"])
    b = df.select("id", fcst.forecast_mean(F.col("x"), 3).alias("yhat"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_fit_linear_per_group(spark):
    rng = np.random.default_rng(2)
    L, P = 4, 2
    rows, ref = [], {}
    for g in ("a", "b"):
        X = rng.normal(size=(120, L))
        Y = X @ rng.normal(size=(L, P)) + (1.0 if g == "a" else -2.0)
        rows += [(g, X[i].tolist(), Y[i].tolist()) for i in range(120)]
        ref[g] = np.linalg.lstsq(np.hstack([X, np.ones((120, 1))]), Y, rcond=None)[0]
    df = spark.createDataFrame(rows, "g string, x array<double>, y array<double>").repartition(3)
    coef = {r["g"]: np.array(r["coef"]).reshape(L + 1, P) for r in fcst.fit_linear(df, "x", "y", L, P, by=["g"]).collect()}
    for g in ref:
        assert np.allclose(coef[g], ref[g], atol=1e-8)


def test_split_ratio_per_series_and_drop_last(spark):
    from tsflow.operators.splits import with_batches
    df = spark.createDataFrame([(s, p) for s in range(2) for p in range(50 + 50 * s)], "s int, pos long")
    r = {(x["s"], x["split"]): x["n"] for x in split_ratio(df, "pos", 5, keys=["s"])
         .groupBy("s", "split").agg(F.count("*").alias("n")).collect()}
    assert r[(0, "train")] == 35 and r[(1, "train")] == 70 and r[(1, "test")] == 25
    b = with_batches(spark.range(21).withColumnRenamed("id", "rk").withColumn("n", F.lit(21)), "rk", 8,
                     n_col="n", drop_last=True)
    assert b.count() == 16 and b.agg(F.max("batch_id")).first()[0] == 1


def test_shortest_series_last_of_ties(spark):
    from tsflow.operators.windows import shortest_series
    lens = spark.createDataFrame([(1, 5), (2, 3), (3, 3), (4, 9)], "k int, n long")
    r = shortest_series(lens, ["k"]).first()
    assert (r["k"], r["n"]) == (3, 3)


def test_decoder_inputs(spark):
    from tsflow.operators.windows import decoder_input, decoder_input_from_x
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0])], "x array<double>, y array<double>")
    r = df.select(decoder_input(F.col("y"), 2, 3).alias("a"), decoder_input_from_x(F.col("x"), 2, 3).alias("b")).first()
    assert r["a"] == [5.0, 6.0, 0.0, 0.0, 0.0]
    assert r["b"] == [3.0, 4.0, 0.0, 0.0, 0.0]


def test_csv_readers_with_declared_schema(spark, tmp_path):
    from pyspark.sql import types as T
    from tsflow.sources import fixtures as fx
    from tsflow.sources.readers import read_cycles, read_points, write_result
    d = fx.daily(spark, "/root/testdata/sf0.001").select(F.col("date").cast("timestamp").alias("date"), "p1", "ot")
    write_result(d, str(tmp_path / "wide"), fmt="csv")
    schema = T.StructType([T.StructField("date", T.TimestampType()), T.StructField("p1", T.DoubleType()),
                           T.StructField("ot", T.DoubleType())])
    back = read_points(spark, str(tmp_path / "wide"), schema)
    assert back.schema == schema
    assert back.exceptAll(d).count() == 0 and d.exceptAll(back).count() == 0
    c = fx.cycles(spark, "/root/testdata/sf0.001").select("battery_id", "cycle_index", "pos", "target")
    write_result(c, str(tmp_path / "cyc"), partition_by=None, fmt="csv")
    cs = T.StructType([T.StructField("battery_id", T.LongType()), T.StructField("cycle_index", T.IntegerType()),
                       T.StructField("pos", T.LongType()), T.StructField("target", T.DoubleType())])
    assert read_cycles(spark, str(tmp_path / "cyc"), cs).exceptAll(c).count() == 0


def test_error_quantiles_are_exact(spark, monkeypatch):
    """For any size, ties and sketch accuracy: what ``describe()`` gives."""
    from tsflow.operators import metrics
    rng = np.random.default_rng(3)
    for accuracy in (metrics.SKETCH, 20):
        monkeypatch.setattr(metrics, "SKETCH", accuracy)
        for values in ([5.0], [1.0, 2.0], [1.0, 2.0, 4.0, 8.0, 16.0, 32.0], [0.0] * 50 + [1.0], rng.normal(size=208), np.round(rng.normal(size=1001), 1)):
            df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
            got = metrics.error_quantiles(df, "v", (0.25, 0.5, 0.75)).first()
            assert np.allclose(list(got), np.quantile(np.asarray(values), (0.25, 0.5, 0.75)))


def test_hot_series_runs_in_many_tasks(spark):
    """Three quarters of all rows in one series, stored and read back: window and join operators
    still spread it over its blocks."""
    from tsflow.operators.series import moving_avg, point_adjust
    from tsflow.operators.windows import cut_windows
    from tsflow.session import store_table
    rows = spark.range(40000).selectExpr("CASE WHEN id < 30000 THEN 0 ELSE 1 + id % 7 END AS s", "id", "sin(id) AS v",
                                         "CAST(sin(id / 50) > 0 AS INT) AS gt", "CAST(sin(id) > 0.99 AS INT) AS pred")
    df = rows.selectExpr("s", "CASE WHEN s = 0 THEN id ELSE floor((id - 30000) / 7) END AS pos", "v", "gt", "pred")
    df = store_table(df.withColumn("b", F.floor(F.col("pos") / 256)), "hot", ["s", "b", "pos"]).drop("b")
    cuts = spark.createDataFrame([(0, 30000, 15000)], "s long, n long, cut long")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for out in (moving_avg(df, ["s"], "v", 25, block=256), point_adjust(df, ["s"], "gt", "pred", block=256),
                    cut_windows(df, cuts, ["s"], "v", "cut", 12000, 10, 2000, block=256, parts=("x",))):
            ran = out.where("s = 0").mapInArrow(lambda it: it, out.schema)  # all columns are needed, so no operator is pruned
            per = ran.groupBy(F.spark_partition_id().alias("p")).count().collect()
            total = sum(r["count"] for r in per)
            assert len(per) >= 4 and max(r["count"] for r in per) < total / 2, per
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_checkpoint_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace
    from tsflow.session import checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda p: None)
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))


def test_mase_scale_by_frequency_and_blocks(spark):
    from tsflow.operators.metrics import mase_scale
    rng = np.random.default_rng(8)
    data = {s: rng.normal(size=n) for s, n in enumerate((1, 3, 40, 200))}
    freq = {0: 1, 1: 4, 2: 4, 3: 2}
    df = spark.createDataFrame([(s, p, float(v), freq[s]) for s, x in data.items() for p, v in enumerate(x)], "s int, pos long, v double, f int")
    for block in (16, 4096):
        got = {r["s"]: r["masep"] for r in mase_scale(df, ["s"], "v", "f", freqs=[1, 2, 4], block=block).collect()}
        for s, x in data.items():
            want = np.abs(x[freq[s]:] - x[:-freq[s]]).mean() if len(x) > freq[s] else None
            assert got[s] is None if want is None else abs(got[s] - want) < 1e-12


def test_filters_and_dataframe_forms(spark):
    from tsflow.functions.calendar import calendar_marks, sincos_calendar, time_features
    from tsflow.operators.filters import feature_mode, keep_long, melt
    from tsflow.operators.series import window_stats
    df = spark.createDataFrame([(1, i, float(i)) for i in range(5)] + [(2, 0, None), (2, 1, 1.0)],
                               "k int, pos long, v double")
    kept = keep_long(df, ["k"], 2, count_col="v")
    assert kept.select("k").distinct().collect()[0]["k"] == 1 and kept.count() == 5
    assert keep_long(df, ["k"], 1).select("k").distinct().count() == 2
    w = spark.createDataFrame([("2024-01-01 00:00:00", 1.0, 2.0, 3.0)], "date string, a double, ot double, b double") \
             .withColumn("date", F.to_timestamp("date"))
    assert feature_mode(w, "S", "ot").columns == ["date", "ot"]
    assert feature_mode(w, "M", "ot").columns == ["date", "a", "b", "ot"]
    with pytest.raises(ValueError):
        feature_mode(w, "X", "ot")
    m = melt(w, ["date"], ["a", "b", "ot"])
    assert sorted(r["channel"] for r in m.collect()) == ["a", "b", "ot"]
    r = calendar_marks(w, "date", minute=True).first()
    assert (r["month"], r["day"], r["weekday"], r["hour"], r["minute"]) == (1, 1, 0, 0, 0)
    assert time_features(w, "date", "h").columns[-4:] == ["hour_of_day", "day_of_week", "day_of_month", "day_of_year"]
    assert len(sincos_calendar(w, "date", 8).first()["temporal_code"]) == 8
    st = window_stats(spark.createDataFrame([([3.0, 1.0, 2.0, 5.0],)], "x array<double>"), "x").first()
    assert (st["min_value"], st["max_value"], st["median_value"], st["trend"]) == (1.0, 5.0, 2.0, "upward")


def test_m4_series_drops_nan_tail_and_selects_group(spark):
    from tsflow.operators.m4 import m4_series
    info = spark.createDataFrame([(1, "Yearly"), (2, "Weekly")], "id int, grp string")
    vals = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, float("nan")), (2, 0, 5.0), (2, 1, None)],
                                 "id int, pos long, value double")
    allv = m4_series(info, vals)
    assert allv.count() == 3
    y = m4_series(info, vals, group="Yearly")
    assert sorted(r["pos"] for r in y.collect()) == [0, 1]


def test_hot_key_positions_spread_over_buckets(spark):
    """One key holds a third of all rows: positions still equal a plain row_number, and the
    hot key's rows are numbered in many (key, bucket) groups rather than one."""
    rng = np.random.default_rng(13)
    n = 3000
    keys = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 50, n))
    rows = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(keys, rng.integers(0, 100000, n)))]
    df = spark.createDataFrame(rows, "k int, t long, i long")
    bucket = F.floor(F.col("t") / 1000)
    a = with_position(df, ["k"], ["t", "i"], bucket=bucket)
    b = with_position(df, ["k"], ["t", "i"])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    groups = df.where(F.col("k") == 0).select(bucket.alias("b")).distinct().count()
    assert groups >= 50
