"""Registered queries: one per operator of SURVEY section 2, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables through ``tsflow.sources.fixtures`` and runs on
the whole tables, as one lazy plan from the driver's files (nothing is stored or cached between
queries).  Parameters are fixed here and mirrored by ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsflow.functions.calendar import calendar_mark_cols, sincos, sincos_calendar, time_feature_cols
from tsflow.operators import forecast as fcst
from tsflow.operators.filters import feature_mode, keep_long, melt
from tsflow.operators import metrics as M
from tsflow.operators import results as R
from tsflow.operators import series as S
from tsflow.operators.m4 import m4_owa, m4_regroup, m4_scores, m4_series
from tsflow.operators.order import global_rank
from tsflow.operators.scaling import fit_scaler, fit_scaler_long, revin, scale, scale_long, unrevin, unscale
from tsflow.operators.splits import split_fixed, split_groups, split_ratio, with_batches, with_epochs
from tsflow.operators.windows import (
    cut_windows, decoder_input, decoder_input_from_x, draw_cut, explode_windows, last_windows, length_histogram, patches,
    series_lengths, shortest_series, sliding_windows, to_arrays, window_arrays, window_rejects,
)
from tsflow.functions.core import hash_bucket, hash_int
from tsflow.session import materialize, scratch_path
from tsflow.sources import fixtures as fx, readers

# ---------------------------------------------------------------- parameters (mirrored in oracles.py)
SEED = 42
LONG = 60                     # keep cycles with more than 60 rows
UNMASKED = (18, 9, 30)        # seq, label, pred of the plain cut window
MASKED = (24, 12, 36)         # masked cut window
HEAD = (24, 12, 48)           # window from the cycle start
RATE = 1.2                    # cutting rate of the masked window
M4_SEQ = 2                    # M4 window: seq = 2 horizons, label = pred = 1 horizon of the group
HIST = 1.5                    # M4 history size
EPOCHS = 3
LAST_L = 6                    # last window of M4 train series
EV_L = 24                     # every window of ev series
QUARTER = (800, 1120, 1440)   # fixed split of the 15-minute table
SLIDE = (48, 24, 24)          # sliding windows on hourly
MARKS = (24, 12, 12)          # sliding windows with calendar marks on daily
BORDERS = (600, 800, 1000)    # fixed split of daily
DAILY_L = 96
PERCENT = 10
PATCH = (8, 4)                # patch length, stride
MA_K = 25
MULTI_K = (13, 25)
SINCOS_D = 16
BS = 8
TOPK = 5
SCALER_LONG_TRAIN = 480       # hours used to fit the per-channel scaler
HALO_BLOCK = 256              # rows per halo block for long single series (>= 4 x window length)
KEYS = fx.CYCLE_KEYS
CH = fx.CYCLE_CHANNELS
DESCRIPTION = "Customer events per user, one value per event."


# ---------------------------------------------------------------- shared sub-plans
# The fixtures are the operators' input tables, lazy plans over the driver tables.
def fixture(spark, sf, name: str):
    return getattr(fx, name)(spark, sf)


def T_cycles(spark, sf):
    return fixture(spark, sf, "cycles")


def T_ev(spark, sf):
    return fixture(spark, sf, "ev")


def T_hourly(spark, sf):
    return fixture(spark, sf, "hourly")


def T_daily(spark, sf):
    return fixture(spark, sf, "daily")


def T_m4c(spark, sf):
    return fixture(spark, sf, "m4c")


def T_anom(spark, sf):
    return fixture(spark, sf, "anom")




def cycle_lengths(spark, sf):
    """Rows per cycle; lengths need no positions, so they are counted before rows are numbered."""
    return series_lengths(fx.cycle_rows(spark, sf), KEYS, count_col="l_shipdate")


def kept_lengths(spark, sf):
    return T_cycles(spark, sf), cycle_lengths(spark, sf).where(F.col("n") > LONG)


def with_splits(spark, sf):
    """Cycle rows and one row per kept cycle with n, split, rank, split_rank."""
    cyc, lens = kept_lengths(spark, sf)
    return cyc, split_groups(lens, KEYS, seed=SEED, keep=["n"])


def cycle_windows(spark, sf, mode, sizes, cols=(), parts=("x", "y"), split=None, align="reference", carry=()):
    """Long-form windows of every kept cycle (or of one split only: the filter comes first)."""
    cyc, w = with_splits(spark, sf)
    if split is not None:
        w = w.where(F.col("split") == split)
    seq, label, pred = sizes
    cuts = draw_cut(w, KEYS, mode, seq, pred, seed=SEED, rate=RATE)
    return cut_windows(cyc, cuts, KEYS, "target", mode, seq, label, pred, cols=cols, parts=parts, align=align,
                       carry=carry), w


def window_rows(spark, sf, mode, sizes, split=None) -> DataFrame:
    """One row per window: arrays x, x_mask, y, y_mask and the cycle's split columns."""
    carry = ["split", "split_rank"]
    return window_arrays(cycle_windows(spark, sf, mode, sizes, split=split, carry=carry)[0], KEYS, extra=carry)


def fold_mean(x: str):
    """Mean of an array as an ordered fold (the same float result on every engine)."""
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)


def window_mean(x_long: DataFrame, keys) -> DataFrame:
    a = to_arrays(x_long, keys, cols=("value",), part=None)
    return a.select(*keys, fold_mean("value").alias("yhat"))


def fc_table(spark, sf, mode="masked", sizes=MASKED, extra: dict | None = None) -> DataFrame:
    """Forecast rows for metrics: forecast = window mean, horizon steps, in one explode per window."""
    _, label, pred = sizes
    extra = extra or {}
    w = window_rows(spark, sf, mode, sizes)
    cells = F.arrays_zip(F.slice("y", label + 1, pred).alias("y"), F.slice("y_mask", label + 1, pred).alias("m"))
    e = w.select(*KEYS, "split", F.floor(F.col("split_rank") / BS).cast("bigint").alias("batch_id"),
                 F.col("split_rank").alias("window_id"), fold_mean("x").alias("yhat"), *(c.alias(n) for n, c in extra.items()), F.posexplode(cells).alias("step", "c"))
    return e.select(*KEYS, "split", "batch_id", "window_id", F.col("step").cast("bigint").alias("step"), F.col("c.y").alias("y"),
                    "yhat", F.col("c.m").alias("mask"), *extra)


def result_rows(spark, sf, masked: bool = False, history: bool = True) -> DataFrame:
    """Result table of the test split: history + truth vs mean forecast, batch of 1."""
    sizes = MASKED if masked else UNMASKED
    w = window_rows(spark, sf, "masked" if masked else "cut", sizes, split="test")
    w = w.select(F.col("split_rank").alias("batch"), F.lit(0).cast("bigint").alias("seq"), "x", "x_mask", "y", "y_mask",
                 F.array_repeat(fold_mean("x"), sizes[2]).alias("f"))
    return R.result_rows(w, ["batch", "seq"], sizes[1], yhat="f", history=history,
                         **({"x_mask": "x_mask", "y_mask": "y_mask"} if masked else {}))


EV_KEYS = ["series_id", "window_id"]


def ev_windows(spark, sf, normalize: bool) -> DataFrame:
    """Every window of ``EV_L`` values of every ``ev`` series: ``(series_id, window_id, x)``.
    Normalised windows are centred and divided by their own deviation, inside the row."""
    w = sliding_windows(T_ev(spark, sf), ["series_id"], "value", EV_L, 0, 0, block=HALO_BLOCK).select(*EV_KEYS, "x")
    if not normalize:
        return w
    w = S.pin(w, "st", F.struct(fold_mean("x").alias("m")))
    w = S.pin(w, "sd", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("st.m")) * (v - F.col("st.m"))) / F.size("x") + 1e-5))
    return w.select(*EV_KEYS, F.transform("x", lambda v: (v - F.col("st.m")) / F.col("sd")).alias("x"))


def m4_parts(spark, sf):
    m = T_m4c(spark, sf)
    train = m.where(F.col("part") == "train").select("id", "pos", "value")
    test = m.where(F.col("part") == "test").select(
        "id", (F.col("pos") - F.greatest(F.col("n") - F.col("horizon"), F.lit(0))).alias("step"), F.col("value").alias("y"))
    return train, test, fx.m4_info(spark, sf)


def m4_forecasts(train, test):
    """Per test step, the train mean (``yhat``) and the last train value (``base``), from one aggregate."""
    fc = train.groupBy("id").agg(F.avg("value").alias("yhat"), F.max_by("value", "pos").alias("base"))
    return test.select("id", "step").join(fc, on="id")


# ---------------------------------------------------------------- sources / projections
def q_scan_wide(spark, sf):
    """The wide table written as CSV and read through the CSV reader."""
    path = scratch_path(spark, "wide-csv")
    readers.write_result(T_daily(spark, sf).select(F.col("date").cast("timestamp").alias("date"), "pos", *fx.DAILY_CHANNELS), path, fmt="csv")
    schema = "date timestamp, pos bigint, " + ", ".join(f"{c} double" for c in fx.DAILY_CHANNELS)
    d = readers.read_points(spark, path, T.StructType.fromDDL(schema))
    return d.select(F.to_date("date").cast("string").alias("date"), "pos", *fx.DAILY_CHANNELS)


def q_scan_cycles(spark, sf):
    """The sensor cycles written as CSV and read through the CSV reader."""
    path = scratch_path(spark, "cycles-csv")
    cyc = T_cycles(spark, sf)
    readers.write_result(cyc, path, fmt="csv")
    return readers.read_cycles(spark, path, cyc.schema)


def _broken_csv(spark, sf):
    """The orders as CSV lines: every 17th key has a letter in its number, every 23rd lacks its last field, every 29th has one more."""
    path, key = scratch_path(spark, "broken-csv"), F.col("o_orderkey")
    line = (F.when(key % 17 == 0, F.concat_ws(",", F.concat(key.cast("string"), F.lit("x")), "o_custkey", "o_orderpriority"))
            .when(key % 23 == 0, F.concat_ws(",", key, "o_custkey"))
            .when(key % 29 == 0, F.concat_ws(",", key, "o_custkey", "o_orderpriority", F.lit("more")))
            .otherwise(F.concat_ws(",", key, "o_custkey", "o_orderpriority")))
    fx.read_table(spark, sf, "orders").select(line.alias("value")).write.text(path)
    return readers.read_rejecting(spark, path, T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_orderpriority string"))


def q_scan_accepted(spark, sf):
    return _broken_csv(spark, sf)[0]


def q_scan_rejects(spark, sf):
    return _broken_csv(spark, sf)[1]


def q_prompt_bank(spark, sf):
    """A bank of one text per market segment, written and read back; each customer's data set looks its text up, and two
    data sets of one family (``ETT*``) share its text."""
    path, c = scratch_path(spark, "prompt-bank"), fx.read_table(spark, sf, "customer")
    family = F.when(F.col("c_mktsegment").isin("FURNITURE", "MACHINERY"), F.lit("ETT")).otherwise(F.col("c_mktsegment"))
    bank = c.where("c_mktsegment != 'HOUSEHOLD'").groupBy(family.alias("name")).agg(
        F.concat(F.lit("The data set has "), F.count(F.lit(1)).cast("string"), F.lit(" series.\nThe last is "), F.max("c_custkey").cast("string"), F.lit(".")).alias("content"))
    readers.write_prompt_bank(bank, path)
    data = F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("ETTh1")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("ETTm2")).otherwise(F.col("c_mktsegment"))
    return readers.with_content(c.select("c_custkey", data.alias("data")), readers.read_prompt_bank(spark, path, partitioned=True), "data")


def q_m4_load(spark, sf):
    """Info joined to ragged values, NaN tails dropped, test part by each group's horizon."""
    return T_m4c(spark, sf).select("id", "grp", "freq", "horizon", "pos", "value", "part")


def q_m4_forecast_file(spark, sf):
    """Naive forecasts written as a file (a row per series, a column per step) and read back long."""
    train, test, _ = m4_parts(spark, sf)
    path, steps = scratch_path(spark, "forecasts"), max(h for _, h in fx.M4_GROUPS.values())
    readers.write_forecasts(m4_forecasts(train, test), path, steps, value="base")
    return readers.read_forecasts(spark, path, steps)


def q_m4_group(spark, sf):
    """Group selection: the values of one group."""
    return m4_series(fx.m4_info(spark, sf), fx.m4_values(spark, sf), group="BUILDING").select("id", "pos", "value", "freq")


def q_feature_modes(spark, sf):
    """Feature mode ``M`` of a table whose target is not last; slots show the order of the channels."""
    d = T_daily(spark, sf).select(F.col("date").cast("string").alias("date"), "pos", "ot", "p1", "p2", "p3", "p4", "px")
    f = feature_mode(d, "M", "ot", keep=["pos"])
    return f.select("date", "pos", F.posexplode(F.array(*f.columns[2:])).alias("slot", "value"))


def q_feature_mode_s(spark, sf):
    """Feature mode ``S``: the target channel only (with its date and position)."""
    d = T_daily(spark, sf).select(F.col("date").cast("string").alias("date"), "pos", *fx.DAILY_CHANNELS)
    return feature_mode(d, "S", "ot", keep=["pos"])


def q_cycle_features(spark, sf):
    """Key column dropped (``drop_bid``), the other key scaled as a feature with the train-fitted scaler."""
    cyc, w = with_splits(spark, sf)
    rows = cyc.join(w.select(*KEYS, "split"), on=KEYS).drop("battery_id") \
              .withColumn("cycle_index", F.col("cycle_index").cast("double"))
    rows = materialize(rows)  # two readers: fit and scale
    feats = ["cycle_index", *CH]
    sc = fit_scaler(rows, feats, where=F.col("split") == "train")
    return scale(rows, sc, feats).select("split", "pos", *feats)


def q_long_cycles(spark, sf):
    return keep_long(T_cycles(spark, sf), KEYS, LONG, count_col="cycle_test_time").select(*KEYS, "pos", "n")


def q_melt_channels(spark, sf):
    return melt(T_hourly(spark, sf), ["pos"], fx.HOURLY_CHANNELS)


def q_horizon_slice(spark, sf):
    label = UNMASKED[1]
    long, _ = cycle_windows(spark, sf, "cut", UNMASKED, parts=("y",))
    return long.where(F.col("step") >= label).select(*KEYS, (F.col("step") - label).alias("h"), "value")


# ---------------------------------------------------------------- splits
def _daily_split(spark, sf, **kw):
    d = T_daily(spark, sf).select("pos", "ot")
    return split_fixed(d, "pos", *BORDERS, lookback=DAILY_L, **kw).select("pos", "split", "ot")


def q_split_fixed(spark, sf):
    return _daily_split(spark, sf)


def q_split_pretrain(spark, sf):
    return _daily_split(spark, sf, pretrain=True)


def q_split_percent(spark, sf):
    return _daily_split(spark, sf, percent=PERCENT)


def q_split_ratio(spark, sf):
    d = T_daily(spark, sf).select("pos", "ot")
    return split_ratio(d, "pos", lookback=DAILY_L).select("pos", "split", "ot")


def q_split_quarter(spark, sf):
    """Fixed split of a 15-minute table: the borders count quarter hours."""
    e = fx.read_table(spark, sf, "events").select(F.window("ts", "15 minutes").start.alias("t"))
    g = global_rank(e.groupBy("t").agg(F.count(F.lit(1)).alias("n")), ["t"], bucket=F.unix_date(F.to_date("t")), name="pos")
    return split_fixed(g, "pos", *QUARTER, lookback=DAILY_L).select("pos", "split", "n")


def q_split_groups(spark, sf):
    _, w = with_splits(spark, sf)
    return w.select(*KEYS, "split", "rank", "split_rank")


def q_cut_points(spark, sf):
    _, lens = kept_lengths(spark, sf)
    return draw_cut(lens, KEYS, "masked", MASKED[0], MASKED[2], seed=SEED, rate=RATE).select(*KEYS, "n", "cut")


def q_batches(spark, sf):
    _, w = with_splits(spark, sf)
    cnt = w.groupBy("split").agg(F.count(F.lit(1)).alias("n_split"))
    b = with_batches(w.join(F.broadcast(cnt), on="split"), "split_rank", BS)
    return b.select(*KEYS, "split", "batch_id", "batch_seq",
                    (F.col("batch_id") < F.floor(F.col("n_split") / BS)).alias("full_batch"))


def q_batches_full(spark, sf):
    """Batches with the last, incomplete one of each split dropped."""
    _, w = with_splits(spark, sf)
    cnt = w.groupBy("split").agg(F.count(F.lit(1)).alias("n_split"))  # three rows
    b = with_batches(w.join(F.broadcast(cnt), on="split"), "split_rank", BS, n_col="n_split", drop_last=True)
    return b.select(*KEYS, "split", "batch_id", "batch_seq")


def q_batches_epoch(spark, sf):
    """Batches of every epoch: train and validation in a new order each, test as it is."""
    _, w = with_splits(spark, sf)
    cnt = w.groupBy("split").agg(F.count(F.lit(1)).alias("n_split"))  # three rows
    e = with_epochs(w.join(F.broadcast(cnt), on="split"), "split_rank", "n_split", EPOCHS, seed=SEED, shuffled=F.col("split") != "test")
    return with_batches(e, "split_rank", BS).select(*KEYS, "split", "epoch", "batch_id", "batch_seq")


# ---------------------------------------------------------------- scaling
def _daily_scaler(spark, sf):
    d = T_daily(spark, sf)
    train = split_fixed(d, "pos", *BORDERS, lookback=DAILY_L).where(F.col("split") == "train")
    return d, fit_scaler(train, fx.DAILY_CHANNELS)


def q_scaler_fit(spark, sf):
    return _daily_scaler(spark, sf)[1]


def q_scaler_apply(spark, sf):
    d, sc = _daily_scaler(spark, sf)
    return scale(d.select("pos", *fx.DAILY_CHANNELS), sc, fx.DAILY_CHANNELS)


def q_scaler_long(spark, sf):
    """Channel-independent (long form) scaler: per-channel stats on the first 480 hours, applied to all."""
    m = q_melt_channels(spark, sf)
    sc = fit_scaler_long(m, "channel", "value", where=F.col("pos") < SCALER_LONG_TRAIN)
    return scale_long(m, sc, "channel", "value")


def q_scaler_inverse(spark, sf):
    """Inverse of the scaled values plus one: the original values plus one deviation."""
    d, sc = _daily_scaler(spark, sf)
    s = scale(d.select("pos", *fx.DAILY_CHANNELS), sc, fx.DAILY_CHANNELS)
    return unscale(s.select("pos", *((F.col(c) + 1).alias(c) for c in fx.DAILY_CHANNELS)), sc, fx.DAILY_CHANNELS)


def q_scaler_transfer(spark, sf):
    """Transfer: the scaler is fitted on one table (daily ``p1``, its first 600 days) and applied to another (``ot``)."""
    d = T_daily(spark, sf)
    sc = fit_scaler(d.where(F.col("pos") < BORDERS[0]).select(F.col("p1").alias("v")), ["v"])
    return scale(d.select("pos", F.col("ot").alias("v")), sc, ["v"])


def _masked_x(spark, sf):
    return cycle_windows(spark, sf, "masked", MASKED, parts=("x",))[0].select(*KEYS, "step", "value")


def q_revin_norm(spark, sf):
    return revin(_masked_x(spark, sf), KEYS).select(*KEYS, "step", "value")


def q_revin_last(spark, sf):
    return revin(_masked_x(spark, sf), KEYS, subtract_last=True).select(*KEYS, "step", "value")


def q_revin_affine(spark, sf):
    return revin(_masked_x(spark, sf), KEYS, affine=(2.0, 0.5)).select(*KEYS, "step", "value")


def q_revin_off(spark, sf):
    """``non_norm``: values pass with the statistics attached; nothing is undone."""
    z = revin(_masked_x(spark, sf), KEYS, non_norm=True)
    return unrevin(z, "value", non_norm=True).select(*KEYS, "step", "value", "rv_last")


def q_revin_denorm(spark, sf):
    """De-normalised 2 z + 1 of each slot: 2 x - mean + deviation of its window."""
    z = revin(_masked_x(spark, sf), KEYS)
    return unrevin(z.withColumn("value", 2 * F.col("value") + 1), "value").select(*KEYS, "step", "value")


def q_revin_denorm_affine(spark, sf):
    """The affine inverse, subtracting the last value: of the normalised value plus one."""
    kw = {"subtract_last": True, "affine": (2.0, 0.5)}
    z = revin(_masked_x(spark, sf), KEYS, **kw)
    return unrevin(z.withColumn("value", F.col("value") + 1), "value", **kw).select(*KEYS, "step", "value")


# ---------------------------------------------------------------- windows
def q_sliding_windows(spark, sf):
    seq, label, pred = SLIDE
    long = q_melt_channels(spark, sf)
    # one long series per channel: halo blocks spread each channel over many tasks
    w = sliding_windows(long, ["channel"], "value", seq, label, pred, block=HALO_BLOCK)
    return explode_windows(w, ["channel"])


def q_window_marks(spark, sf):
    seq, label, pred = MARKS
    d = T_daily(spark, sf)
    d = d.select("pos", "ot", F.struct(*calendar_mark_cols(F.col("date").cast("timestamp"))).alias("mk"))
    # a single series: without halo blocks the whole table would be one window partition
    w = sliding_windows(d.withColumn("_one", F.lit(1)), ["_one"], "ot", seq, label, pred, extra=["mk"],
                        block=HALO_BLOCK)
    x = w.select("window_id", F.lit("x").alias("part"), F.arrays_zip(F.col("x").alias("v"), F.col("mk_x").alias("m")).alias("z"))
    y = w.select("window_id", F.lit("y").alias("part"), F.arrays_zip(F.col("y").alias("v"), F.col("mk_y").alias("m")).alias("z"))
    e = x.unionByName(y).select("window_id", "part", F.posexplode("z").alias("step", "e"))
    return e.select("window_id", "part", F.col("step").cast("bigint").alias("step"), F.col("e.v").alias("value"),
                    F.col("e.m.month").alias("month"), F.col("e.m.day").alias("day"), F.col("e.m.weekday").alias("weekday"))


def q_cut_windows(spark, sf):
    return cycle_windows(spark, sf, "cut", UNMASKED, cols=CH)[0]


def q_masked_windows(spark, sf):
    return cycle_windows(spark, sf, "masked", MASKED, cols=CH)[0]


def q_masked_windows_cut(spark, sf):
    """Masked windows with y aligned to the cut."""
    return cycle_windows(spark, sf, "masked", MASKED, align="cut")[0]


def q_head_windows(spark, sf):
    return cycle_windows(spark, sf, "head", HEAD)[0]


def m4_lengths(train, info):
    """Train length of every series of the info table, 0 where it has no train value."""
    return info.join(series_lengths(train, ["id"]), on="id", how="left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def _m4_cuts(spark, sf):
    train, _, info = m4_parts(spark, sf)
    return train, m4_lengths(train, info).withColumn("seq", M4_SEQ * F.col("horizon"))


def q_m4_windows(spark, sf):
    """M4 windows, each with the sizes of its group."""
    train, lens = _m4_cuts(spark, sf)
    cuts = draw_cut(lens, ["id"], "m4", "seq", "horizon", seed=SEED, history=HIST)
    return cut_windows(train, cuts, ["id"], "value", "m4", "seq", "horizon", "horizon")


def q_m4_rejects(spark, sf):
    """Series whose train part is too short for any cut, or empty."""
    _, lens = _m4_cuts(spark, sf)
    return window_rejects(lens, ["id"], "m4", "seq", "horizon", history=HIST)


def q_last_windows(spark, sf):
    """Last windows of all series of the info table; one without train values is all padding."""
    train, _, info = m4_parts(spark, sf)
    return last_windows(train, m4_lengths(train, info), ["id"], "value", LAST_L)


def _slots(df, keys, col):
    return df.select(*keys, F.posexplode(col).alias("step", "value")).withColumn("step", F.col("step").cast("bigint"))


def q_decoder_input(spark, sf):
    _, label, pred = MASKED
    y = to_arrays(cycle_windows(spark, sf, "masked", MASKED, parts=("y",))[0], KEYS, cols=("value",), part=None)
    return _slots(y, KEYS, decoder_input(F.col("value"), label, pred))


def q_decoder_input_m4(spark, sf):
    """M4 form: the last ``label`` values of x, then zeros."""
    _, label, pred = MASKED
    x = to_arrays(_masked_x(spark, sf), KEYS, cols=("value",), part=None)
    return _slots(x, KEYS, decoder_input_from_x(F.col("value"), label, pred))


def q_patches(spark, sf):
    seq = MASKED[0]
    plen, stride = PATCH
    arr = to_arrays(_masked_x(spark, sf), KEYS, cols=("value",), part=None)
    p = arr.select(*KEYS, F.posexplode(patches(F.col("value"), seq, plen, stride)).alias("patch_id", "pv"))
    return p.select(*KEYS, F.col("patch_id").cast("bigint").alias("patch_id"),
                    F.posexplode("pv").alias("j", "value")).withColumn("j", F.col("j").cast("bigint"))


def q_patch_masks(spark, sf):
    """The mask of each patch slot, cut like the values."""
    plen, stride = PATCH
    m = cycle_windows(spark, sf, "masked", MASKED, parts=("x",))[0].select(*KEYS, "step", "mask")
    arr = to_arrays(m, KEYS, cols=("mask",), part=None)
    p = arr.select(*KEYS, F.posexplode(patches(F.col("mask"), MASKED[0], plen, stride)).alias("patch_id", "pv"))
    return p.select(*KEYS, F.col("patch_id").cast("bigint").alias("patch_id"),
                    F.posexplode("pv").alias("j", "mask")).withColumn("j", F.col("j").cast("bigint"))


def q_length_histogram(spark, sf):
    return length_histogram(cycle_lengths(spark, sf))


def q_shortest_cycle(spark, sf):
    """Arg-min cycle length; among ties the last in key order (as the reference's loop keeps)."""
    return shortest_series(cycle_lengths(spark, sf), KEYS)


def q_window_rejects(spark, sf):
    return window_rejects(cycle_lengths(spark, sf), KEYS, "cut", MASKED[0], MASKED[2])


# ---------------------------------------------------------------- calendar
def q_calendar_marks(spark, sf):
    e = T_ev(spark, sf)
    return e.select("series_id", "pos", *calendar_mark_cols("ts", minute=True))


def q_time_features(spark, sf):
    e = T_ev(spark, sf)
    return e.select("series_id", "pos", *time_feature_cols("ts", "15min"))


def q_time_features_daily(spark, sf):
    d = T_daily(spark, sf)
    return d.select("pos", *time_feature_cols(F.col("date").cast("timestamp"), "D"))


ALL_FREQS = ("Q", "M", "W-SUN", "B", "H", "S")


def q_time_features_all(spark, sf):
    """Features of the other frequencies, by frequency and slot (their order is part of the definition)."""
    per = [F.struct(F.lit(f).alias("freq"), F.array(*time_feature_cols("ts", f)).alias("v")) for f in ALL_FREQS]
    e = T_ev(spark, sf).select("series_id", "pos", F.explode(F.array(*per)).alias("p"))
    return e.select("series_id", "pos", F.col("p.freq").alias("freq"), F.posexplode("p.v").alias("slot", "value"))


def q_sincos_position(spark, sf):
    h = T_hourly(spark, sf)
    return h.select("pos", F.posexplode(sincos(F.col("pos"), SINCOS_D)).alias("j", "value")) \
            .withColumn("j", F.col("j").cast("bigint"))


def q_sincos_calendar(spark, sf):
    h = sincos_calendar(T_hourly(spark, sf), "hour_ts", SINCOS_D, name="code")
    return h.select("pos", F.posexplode("code").alias("j", "value")).withColumn("j", F.col("j").cast("bigint"))


# ---------------------------------------------------------------- series features
# halo blocks: a user holding a large share of all events still spreads over many tasks
def q_moving_avg(spark, sf):
    return S.moving_avg(T_ev(spark, sf), ["series_id"], "value", MA_K, block=HALO_BLOCK).select(
        "series_id", "pos", "trend")


def q_decompose(spark, sf):
    return S.decompose(T_ev(spark, sf), ["series_id"], "value", MA_K, block=HALO_BLOCK).select(
        "series_id", "pos", "trend", "seasonal")


def q_decompose_multi(spark, sf):
    return S.decompose(T_ev(spark, sf), ["series_id"], "value", list(MULTI_K), block=HALO_BLOCK).select(
        "series_id", "pos", "trend", "seasonal")


def q_decomp_init(spark, sf):
    seq, label, pred = MASKED
    arr = to_arrays(_masked_x(spark, sf), KEYS, cols=("value",), part=None)
    tr, se = S.decomp_continuation(F.col("value"), seq, MA_K, label, pred)
    parts = F.array(F.struct(F.lit("trend").alias("part"), tr.alias("a")),
                    F.struct(F.lit("seasonal").alias("part"), se.alias("a")))
    e = arr.select(*KEYS, F.explode(parts).alias("p"))
    return e.select(*KEYS, F.col("p.part").alias("part"), F.posexplode("p.a").alias("step", "value")) \
            .withColumn("step", F.col("step").cast("bigint"))


def _ev_autocorr(spark, sf):
    a = ev_windows(spark, sf, normalize=True)
    # pinned: the correlation is computed once per window, not per reference
    return S.pin(a, "r", S.autocorr(F.col("x"), EV_L))


def _lag(df, col, name="lag", value="r"):
    return df.select(*EV_KEYS, F.posexplode(col).alias(name, value)).withColumn(name, F.col(name).cast("bigint"))


def q_autocorr(spark, sf):
    return _lag(_ev_autocorr(spark, sf), "r")


def q_top_lags(spark, sf):
    t = _lag(_ev_autocorr(spark, sf), S.top_lags(F.col("r"), TOPK), "rank", "lag")
    return t.withColumn("lag", F.col("lag").cast("bigint"))


def q_period_agg(spark, sf):
    return _lag(S.period_agg(_ev_autocorr(spark, sf), "x", EV_L, 1.0, r="r", name="v"), "v", "t", "value")


def q_period_agg_full(spark, sf):
    """Per-channel form: every (window, channel) by its own correlation, on the hourly channels."""
    w = sliding_windows(q_melt_channels(spark, sf), ["channel"], "value", EV_L, 0, 0, block=HALO_BLOCK).select("channel", "window_id", "x")
    a = S.period_agg_full(w, "x", EV_L, 0.7, name="v")
    return a.select("channel", "window_id", F.posexplode("v").alias("t", "value")).withColumn("t", F.col("t").cast("bigint"))


def q_period_agg_batch(spark, sf):
    """Training form: top lags shared by each batch of 8 windows (mean correlation), weights per window.
    Batches are drawn by hash, so the rank has a fixed number of buckets."""
    a = _ev_autocorr(spark, sf).withColumn("_h", hash_int("batch", SEED, EV_KEYS))
    a = global_rank(a, ["_h", *EV_KEYS], bucket=hash_bucket("batch", SEED, EV_KEYS, 4), name="rk", bounded_buckets=True)
    a = with_batches(a, "rk", BS)
    a = S.shared_lag_corr(a, "batch_id", "r", EV_L)
    return _lag(S.period_agg(a, "x", EV_L, 1.0, r="r", rank_r="r_batch", name="v"), "v", "t", "value")


def q_align_len(spark, sf):
    """Arrays of 10 to 39 values brought to the window's length."""
    a = ev_windows(spark, sf, normalize=False)
    b = F.slice(F.concat("x", "x"), F.lit(1), (10 + F.col("series_id") % 30).cast("int"))
    return _lag(a.select(*EV_KEYS, S.align_len(F.col("x"), b).alias("v")), "v", "t", "value")


def q_window_stats(spark, sf):
    return S.window_stats(ev_windows(spark, sf, normalize=False), "x").drop("x")


def q_prompt_text(spark, sf):
    st = S.window_stats(_ev_autocorr(spark, sf), "x").withColumn("lags", S.top_lags(F.col("r"), TOPK))
    p = S.prompt_text(F.lit(DESCRIPTION), F.col("min_value"), F.col("max_value"), F.col("median_value"),
                      F.col("trend"), F.col("lags"), EV_L, MASKED[2])
    return st.select(*EV_KEYS, p.alias("prompt"))


def q_point_adjust(spark, sf):
    return S.point_adjust(T_anom(spark, sf), ["series_id"], "gt", "pred").select(
        "series_id", "pos", "gt", "pred", "pred_adj")


def q_accuracy(spark, sf):
    a = materialize(S.point_adjust(T_anom(spark, sf), ["series_id"], "gt", "pred").withColumn("_k", F.lit(1)))  # two readers
    raw, adj = M.accuracy(a, "gt", "pred", ["_k"], "acc_raw"), M.accuracy(a, "gt", "pred_adj", ["_k"], "acc_adj")
    return raw.join(adj, on="_k").drop("_k")


# ---------------------------------------------------------------- metrics on fc
def fc_data(spark, sf) -> DataFrame:
    """Forecast cells of the unmasked windows (the plain metrics take no mask)."""
    return fc_table(spark, sf, "cut", UNMASKED)


def q_metrics_basic(spark, sf):
    return M.metrics(fc_data(spark, sf), "yhat", "y", by=["split"])


def q_rse(spark, sf):
    return M.rse(fc_data(spark, sf), "yhat", "y", by=["split"])


def q_corr_ref(spark, sf):
    return M.corr_ref(fc_data(spark, sf), "yhat", "y", channel="step", by=["split"])


def q_metrics_eps(spark, sf):
    return M.metrics_eps(fc_data(spark, sf), "yhat", "y", by=["split"])


def q_mape_abs(spark, sf):
    """The analysis form of MAPE: abs of the guarded ratio."""
    return fc_data(spark, sf).groupBy("split").agg(M.mape_abs("yhat", "y"))


def q_metrics_masked(spark, sf):
    fc = fc_table(spark, sf)
    return fc.groupBy("split").agg(*M.eps_aggs("yhat", "y", "mask"), M.mse_loss_agg("yhat", "y", "mask"))


def q_smape_loss(spark, sf):
    return fc_table(spark, sf).groupBy("split").agg(M.smape_loss_agg("yhat", "y", "mask"))


def q_mape_loss(spark, sf):
    return fc_table(spark, sf).groupBy("split").agg(M.mape_loss_agg("yhat", "y", "mask"))


def q_mase_loss(spark, sf):
    fc = fc_table(spark, sf, extra={"masep": M.mase_scale_array("x", 1)})
    return fc.groupBy("split").agg(M.mase_loss_agg("yhat", "y", "mask", "masep"))


def q_metrics_batched(spark, sf):
    """Means over batches, and beside them the loss over the whole set."""
    fc = materialize(fc_table(spark, sf))  # two readers
    return M.batched_metrics(fc, "batch_id", [M.smape_loss_agg("yhat", "y", "mask"), *M.eps_aggs("yhat", "y", "mask")],
                             by=["split"], overall=[M.smape_loss_agg("yhat", "y", "mask", "smape_all"),
                                                    M.mse_loss_agg("yhat", "y", "mask", "mse_all")])


def q_eval_last(spark, sf):
    train, test, _ = m4_parts(spark, sf)
    lw = last_windows(train, series_lengths(train, ["id"]), ["id"], "value", LAST_L)
    d = test.join(window_mean(lw, ["id"]), on="id")
    return d.agg(M.smape_loss_agg("yhat", "y", F.lit(1.0)))


def eval_report(spark, sf) -> DataFrame:
    """Flagship: kept cycles -> group split -> train-fitted scaler -> cut windows -> mean
    forecast -> per-split report (MSE criterion + guarded bundle, batch means)."""
    seq, label, pred = UNMASKED
    cyc, w = with_splits(spark, sf)
    rows = materialize(cyc.join(w.select(*KEYS, "split"), on=KEYS))  # two readers: fit and scale
    sc = fit_scaler(rows, CH, where=F.col("split") == "train")
    rows_s = scale(rows, sc, CH)
    cuts = draw_cut(w, KEYS, "cut", seq, pred, seed=SEED)
    carry = ["split", "split_rank"]
    d = window_arrays(cut_windows(rows_s, cuts, KEYS, "target", "cut", seq, label, pred, carry=carry), KEYS, extra=carry).select(
        "split", F.floor(F.col("split_rank") / BS).alias("batch_id"), fold_mean("x").alias("yhat"),
        F.explode(F.slice("y", label + 1, pred)).alias("value"))
    return M.batched_metrics(d, "batch_id", [M.mse_loss_agg("yhat", "value"), *M.eps_aggs("yhat", "value")],
                             by=["split"])


# ---------------------------------------------------------------- M4 scoring
def _m4_scores(spark, sf):
    """Model and baseline, scored in one pass with each group's own frequency and horizon."""
    train, test, info = m4_parts(spark, sf)
    return m4_scores(m4_forecasts(train, test), test, train, info, fx.M4_FREQS, fc_cols=("yhat", "base"))


def q_m4_group_scores(spark, sf):
    return _m4_scores(spark, sf).where(F.col("forecast") == "yhat").drop("forecast")


def q_mase(spark, sf):
    train, test, info = m4_parts(spark, sf)
    sc = M.mase_scale(train.join(info, on="id"), ["id"], "value", "freq", freqs=fx.M4_FREQS)
    e = test.join(m4_forecasts(train, test), on=["id", "step"]).groupBy("id").agg(F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("_mae"))
    return e.join(sc, on="id").select("id", F.try_divide(F.col("_mae"), F.col("masep")).alias("mase"))


def _m4_summary(spark, sf):
    return m4_regroup(_m4_scores(spark, sf), fx.M4_MAIN_GROUPS, ["smape", "mape", "mase"], by=["forecast"])


def q_m4_summary(spark, sf):
    return _m4_summary(spark, sf).where(F.col("forecast") == "yhat").drop("forecast")


def q_m4_owa(spark, sf):
    return m4_owa(_m4_summary(spark, sf), "yhat", "base")


# ---------------------------------------------------------------- result analysis
def _result(spark, sf):
    return result_rows(spark, sf).drop("mask")


def q_result_table(spark, sf):
    return _result(spark, sf)


def q_result_horizon(spark, sf):
    """The result table without history."""
    return result_rows(spark, sf, history=False).drop("mask")


def q_result_roundtrip(spark, sf):
    """Result sink: written partitioned by a batch bucket under the shared checkpoint folder, read back."""
    path = scratch_path(spark, "result")
    res = _result(spark, sf).withColumn("bucket", F.pmod(F.xxhash64("batch"), F.lit(16)))
    readers.write_result(res, path, partition_by=["bucket"])
    return spark.read.parquet(path).select("batch", "seq", "id", "y", "yhat")


def q_result_dif(spark, sf):
    return R.with_dif(_result(spark, sf))


def q_result_nonzero(spark, sf):
    return R.nonzero_predictions(_result(spark, sf))


def q_endpoint_error(spark, sf):
    seq, _, pred = UNMASKED
    return R.endpoint_error(_result(spark, sf), seq + pred - 1)


def q_error_quantiles(spark, sf):
    seq, _, pred = UNMASKED
    e = R.with_dif(_result(spark, sf)).where(F.col("id") == seq + pred - 1).select(F.abs("dif").alias("abs_dif"))
    return M.error_quantiles(materialize(e), "abs_dif")  # several readers


def q_process_error(spark, sf):
    return R.process_error(_result(spark, sf), UNMASKED[0])


def q_series_rmse(spark, sf):
    return R.series_rmse(_result(spark, sf), UNMASKED[0] - 1)


def q_worst_series(spark, sf):
    return R.worst_series(R.series_rmse(_result(spark, sf), UNMASKED[0] - 1), 10)


def q_result_border(spark, sf):
    return R.tail_border(result_rows(spark, sf, masked=True), MASKED[0])


# ---------------------------------------------------------------- forecasters
def _masked_fc_windows(spark, sf):
    return to_arrays(_masked_x(spark, sf), KEYS, cols=("value",), part=None).withColumnRenamed("value", "x")


def _explode_fc(df, col="yhat", keys=KEYS):
    return df.select(*keys, F.posexplode(col).alias("h", "yhat")).withColumn("h", F.col("h").cast("bigint"))


def q_fc_mean(spark, sf):
    w = _masked_fc_windows(spark, sf)
    return _explode_fc(w.select(*KEYS, fcst.forecast_mean(F.col("x"), MASKED[2]).alias("yhat")))


def q_score_windows(spark, sf):
    w = _masked_fc_windows(spark, sf)
    return _explode_fc(fcst.score_windows(w, fcst.mean_predictor(MASKED[2]), "x", MASKED[2], KEYS))


def q_score_marks(spark, sf):
    """A predictor that also takes calendar marks of the horizon and the decoder input."""
    seq, label, pred = MARKS
    d = T_daily(spark, sf).select("pos", "ot", F.weekday("date").cast("double").alias("wd"), F.lit(1).alias("_one"))
    w = sliding_windows(d, ["_one"], "ot", seq, label, pred, extra=["wd"], block=HALO_BLOCK)
    w = w.select("window_id", "x", "wd_y", decoder_input(F.col("y"), label, pred).alias("dec"))

    def predict(x, marks, dec):
        return x[:, -1:] + 100.0 * marks[:, label:] + 0.5 * dec[:, :1]
    return _explode_fc(fcst.score_windows(w, predict, "x", pred, ["window_id"], inputs=["wd_y", "dec"]), keys=["window_id"])


def q_fc_revin(spark, sf):
    """Normalise -> forecast in normalised space (half the last value, plus one) -> de-normalise."""
    return fcst.with_revin(_masked_x(spark, sf), KEYS, MASKED[2],
                           forecaster=lambda x, pred: F.array_repeat(0.5 * F.element_at(x, -1) + 1.0, pred))


def q_fc_drift(spark, sf):
    w = _masked_fc_windows(spark, sf)
    return _explode_fc(w.select(*KEYS, fcst.forecast_drift(F.col("x"), MASKED[2]).alias("yhat")))


def _linear(spark, sf, seq, pred):
    """Windows of the last ``seq`` inputs and the first ``pred`` horizon values, by split."""
    label = UNMASKED[1]
    w = window_rows(spark, sf, "cut", UNMASKED)
    return w.select(*KEYS, "split", F.slice("x", -seq, seq).alias("x"), F.slice("y", label + 1, pred).alias("y"))


def _fc_linear(spark, sf, seq, pred):
    win = materialize(_linear(spark, sf, seq, pred))  # two readers: fit and forecast
    coef = fcst.fit_linear(win.where(F.col("split") == "train"), "x", "y", seq, pred)
    return _explode_fc(fcst.forecast_linear(win.where(F.col("split") == "test"), coef, "x", seq, pred))


def q_fc_linear(spark, sf):
    """Fit on the train windows (last two inputs -> three steps), forecast the test windows; the
    two-input least squares has a closed SQL form."""
    return _fc_linear(spark, sf, 2, 3)


def q_fc_linear_full(spark, sf):
    """The same with all inputs and the whole horizon."""
    return _fc_linear(spark, sf, UNMASKED[0], UNMASKED[2])


def q_fc_linear_1(spark, sf):
    """Least-squares forecaster with seq = pred = 1 (last input -> first horizon value), fitted
    on the train windows: its two coefficients have a closed SQL form (regression slope/intercept)."""
    win = _linear(spark, sf, 1, 1).where(F.col("split") == "train")
    return fcst.fit_linear(win, "x", "y", 1, 1).select(F.col("coef")[0].alias("slope"), F.col("coef")[1].alias("intercept"))


def q_fc_linear_channel(spark, sf):
    """Individual mode: one least-squares model per hourly channel (one input, two steps), fitted on
    the first 480 windows and applied to all windows of its channel."""
    w = sliding_windows(q_melt_channels(spark, sf), ["channel"], "value", 1, 0, 2, block=HALO_BLOCK)
    coef = fcst.fit_linear(w.where(F.col("window_id") < SCALER_LONG_TRAIN), "x", "y", 1, 2, by=["channel"])
    return _explode_fc(fcst.forecast_linear(w, coef, "x", 1, 2, by=["channel"]), keys=["channel", "window_id"])


QUERIES = {
    # sources / projections / joins
    "scan_wide": q_scan_wide, "scan_cycles": q_scan_cycles, "m4_load": q_m4_load, "m4_group": q_m4_group, "m4_forecast_file": q_m4_forecast_file,
    "scan_accepted": q_scan_accepted, "scan_rejects": q_scan_rejects, "prompt_bank": q_prompt_bank,
    "feature_modes": q_feature_modes, "feature_mode_s": q_feature_mode_s, "cycle_features": q_cycle_features, "long_cycles": q_long_cycles, "melt_channels": q_melt_channels,
    "horizon_slice": q_horizon_slice,
    # splits / batching
    "split_fixed": q_split_fixed, "split_ratio": q_split_ratio, "split_pretrain": q_split_pretrain,
    "split_percent": q_split_percent, "split_groups": q_split_groups, "cut_points": q_cut_points,
    "batches": q_batches, "batches_full": q_batches_full, "batches_epoch": q_batches_epoch, "split_quarter": q_split_quarter,
    # scaling
    "scaler_fit": q_scaler_fit, "scaler_apply": q_scaler_apply, "scaler_inverse": q_scaler_inverse,
    "scaler_long": q_scaler_long, "scaler_transfer": q_scaler_transfer,
    "revin_affine": q_revin_affine, "revin_off": q_revin_off, "revin_denorm_affine": q_revin_denorm_affine,
    "revin_norm": q_revin_norm, "revin_last": q_revin_last, "revin_denorm": q_revin_denorm,
    # windows
    "sliding_windows": q_sliding_windows, "window_marks": q_window_marks, "cut_windows": q_cut_windows,
    "masked_windows": q_masked_windows, "head_windows": q_head_windows, "m4_windows": q_m4_windows,
    "last_windows": q_last_windows, "decoder_input": q_decoder_input, "patches": q_patches,
    "masked_windows_cut": q_masked_windows_cut, "m4_rejects": q_m4_rejects, "decoder_input_m4": q_decoder_input_m4,
    "patch_masks": q_patch_masks, "length_histogram": q_length_histogram,
    "shortest_cycle": q_shortest_cycle, "window_rejects": q_window_rejects,
    # calendar
    "calendar_marks": q_calendar_marks, "time_features": q_time_features,
    "time_features_daily": q_time_features_daily, "time_features_all": q_time_features_all,
    "sincos_position": q_sincos_position, "sincos_calendar": q_sincos_calendar,
    # series
    "moving_avg": q_moving_avg, "decompose": q_decompose, "decompose_multi": q_decompose_multi,
    "decomp_init": q_decomp_init, "autocorr": q_autocorr, "top_lags": q_top_lags, "period_agg": q_period_agg,
    "period_agg_batch": q_period_agg_batch, "period_agg_full": q_period_agg_full, "align_len": q_align_len,
    "window_stats": q_window_stats, "prompt_text": q_prompt_text, "point_adjust": q_point_adjust,
    "accuracy": q_accuracy,
    # metrics
    "metrics_basic": q_metrics_basic, "rse": q_rse, "corr_ref": q_corr_ref, "metrics_eps": q_metrics_eps, "mape_abs": q_mape_abs,
    "metrics_masked": q_metrics_masked, "smape_loss": q_smape_loss, "mape_loss": q_mape_loss,
    "mase_loss": q_mase_loss, "metrics_batched": q_metrics_batched, "eval_last": q_eval_last,
    "eval_report": eval_report,
    # M4
    "m4_group_scores": q_m4_group_scores, "mase": q_mase, "m4_summary": q_m4_summary, "m4_owa": q_m4_owa,
    # results
    "result_table": q_result_table, "result_horizon": q_result_horizon, "result_roundtrip": q_result_roundtrip, "result_dif": q_result_dif, "result_nonzero": q_result_nonzero,
    "endpoint_error": q_endpoint_error, "error_quantiles": q_error_quantiles, "process_error": q_process_error,
    "series_rmse": q_series_rmse, "worst_series": q_worst_series, "result_border": q_result_border,
    # forecasters
    "fc_mean": q_fc_mean, "score_windows": q_score_windows, "fc_revin": q_fc_revin, "fc_linear": q_fc_linear, "fc_linear_1": q_fc_linear_1,
    "fc_linear_full": q_fc_linear_full, "fc_linear_channel": q_fc_linear_channel, "fc_drift": q_fc_drift, "score_marks": q_score_marks,
}
