"""Windowing: sliding frames, cut windows with padding masks, last windows, patches.

Two representations:

* long form ``(keys..., part, step, value, mask[, channels...])`` -- one row per
  slot; built with an equi-join of the rows to a one-row-per-window table plus a
  range predicate, so no group is ever gathered into one array;
* array form -- bounded arrays (length L, label+pred) for model input, gathered
  from the long form per window (the gather is bounded by the window length).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsflow.functions.core import uniform_int

MODES = ("cut", "masked", "head", "m4")


# ---------------------------------------------------------------- counts / cuts
def series_lengths(df: DataFrame, keys: Sequence[str], count_col: str | None = None, name: str = "n") -> DataFrame:
    """One row per series with its length (partial aggregate, tiny output)."""
    cnt = F.count(F.col(count_col)) if count_col else F.count(F.lit(1))
    return df.groupBy(*keys).agg(cnt.alias(name))


def _num(v) -> Column:
    """A number, or a column of the cuts table (by name or as it is) that holds one per series."""
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def cut_range(mode: str, n: Column, seq, pred, rate=1.2, history=1.5):
    """[low, high) of the random cut for each window mode; all sizes may differ by series."""
    seq, pred = _num(seq), _num(pred)
    if mode == "cut":
        return seq, n - pred
    if mode == "masked":
        return F.greatest(F.lit(1), n - F.floor(pred * _num(rate).cast("double"))), n
    if mode == "m4":
        return F.greatest(F.lit(1), n - F.floor(_num(history).cast("double") * pred)), n
    if mode == "head":
        return seq, seq + 1
    raise ValueError(f"unknown mode {mode!r}")


def draw_cut(lengths: DataFrame, keys: Sequence[str], mode: str, seq, pred, seed: int = 42,
             rate=1.2, history=1.5, n: str = "n", name: str = "cut") -> DataFrame:
    """Seeded cut point per series in the mode's [low, high); null when the range is empty.
    Sizes are numbers, or columns of ``lengths`` where they differ by series (M4 groups)."""
    low, high = cut_range(mode, F.col(n), seq, pred, rate, history)
    if mode == "head":
        return lengths.withColumn(name, _num(seq).cast("bigint"))
    return lengths.withColumn(name, uniform_int("cut", seed, keys, low, high).cast("bigint"))


def window_rejects(lengths: DataFrame, keys: Sequence[str], mode: str, seq: int, pred: int,
                   rate: float = 1.2, history: float = 1.5, n: str = "n") -> DataFrame:
    """Series whose cut range is empty (low >= high) -- reported instead of raised."""
    low, high = cut_range(mode, F.col(n), seq, pred, rate, history)
    return (lengths.select(*keys, n, low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))
            .where(F.col("low") >= F.col("high")))


def length_histogram(lengths: DataFrame, n: str = "n") -> DataFrame:
    return lengths.groupBy(F.col(n).alias("len")).agg(F.count(F.lit(1)).alias("n_series"))


def shortest_series(lengths: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Shortest series; among ties the last in key order (the reference keeps the last of ties)."""
    order = F.struct(-F.col(n), *[F.col(k) for k in keys])
    return lengths.agg(F.max_by(F.struct(*keys, n), order).alias("s")).select("s.*")


# ---------------------------------------------------------------- window bounds
def window_bounds(cuts: DataFrame, mode: str, seq, label, pred, align: str = "reference",
                  n: str = "n", cut: str = "cut") -> DataFrame:
    """Per window: data ranges [x_lo, x_hi), [y_lo, y_hi), x offset (right alignment), masks, sizes."""
    N, C = F.col(n), F.col(cut)
    seq, label, pred = _num(seq), _num(label), _num(pred)
    if mode == "cut":
        x_lo, x_hi, y_lo, y_hi = C - seq, C, C - label, C + pred
        x_m = y_m = 0.0
    elif mode == "masked":
        x_lo, x_hi = F.greatest(F.lit(0), C - seq), C
        if align == "reference":
            y_lo, y_hi = F.greatest(F.lit(1), C - label), F.least(N, C + pred)
        else:
            y_lo, y_hi = F.greatest(F.lit(0), C - label), F.least(N, C + pred)
        x_m = y_m = 1.0
    elif mode == "head":
        x_lo, x_hi = F.lit(0), F.least(N, seq)
        y_lo, y_hi = seq - label, F.least(N, seq + pred)
        x_m, y_m = 0.0, 1.0
    elif mode == "m4":
        x_lo, x_hi = F.greatest(F.lit(0), C - seq), C
        y_lo, y_hi = F.greatest(F.lit(0), C - label), F.least(N, C + pred)
        x_m = y_m = 1.0
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # right-aligned x (mask modes); 'cut'/'head' start at slot 0
    x_off = (seq - (x_hi - x_lo)) if mode in ("masked", "m4") else F.lit(0)
    # align='cut': y slot = pos - (cut - label); rows before 0 are pads
    y_off = (y_lo - (C - label)) if (mode == "masked" and align == "cut") else F.lit(0)
    return cuts.where(F.col(cut).isNotNull()).select(
        "*", x_lo.cast("bigint").alias("_x_lo"), x_hi.cast("bigint").alias("_x_hi"),
        x_off.cast("bigint").alias("_x_off"), y_lo.cast("bigint").alias("_y_lo"),
        y_hi.cast("bigint").alias("_y_hi"), y_off.cast("bigint").alias("_y_off"),
        F.lit(x_m).alias("_x_m"), F.lit(y_m).alias("_y_m"),
        seq.cast("bigint").alias("_x_len"), (label + pred).cast("bigint").alias("_y_len"))


def cut_windows(df: DataFrame, cuts: DataFrame, keys: Sequence[str], target: str, mode: str,
                seq, label, pred, cols: Sequence[str] = (), pos: str = "pos",
                align: str = "reference", n: str = "n", cut: str = "cut",
                parts: Sequence[str] = ("x", "y"), block: int = 1 << 16, carry: Sequence[str] = ()) -> DataFrame:
    """Long-form window slots ``(keys, part, step, value, mask, cols...)``.

    ``df``: series rows ``(keys, pos, target, cols...)``; ``cuts``: one row per series
    with ``n`` and ``cut`` (see ``draw_cut``).  ``value`` is the target channel; x rows
    also carry every channel in ``cols`` (the reference feeds all channels as x).
    Pads carry 0 and mask 0.  ``parts`` limits the work to x or y; ``carry`` names columns of ``cuts``
    that every slot of the window gets.

    Rows meet their window by (series, block of ``block`` positions): a window names the one or
    few blocks that it touches, so a series of any length is spread over its blocks, whichever
    join Spark picks, and rows of other blocks are dropped by the join itself.
    """
    keys = list(keys)
    cols = list(cols)
    b = window_bounds(cuts, mode, seq, label, pred, align, n, cut).select(
        *keys, *carry, "_x_lo", "_x_hi", "_x_off", "_y_lo", "_y_hi", "_y_off", "_x_m", "_y_m", "_x_len", "_y_len")
    rows = df.select(*keys, pos, target, *[c for c in cols if c not in keys and c != target and c != pos])
    first = F.least(*(F.col(f"_{p}_lo") for p in parts)) if len(parts) > 1 else F.col(f"_{parts[0]}_lo")
    last = (F.greatest(*(F.col(f"_{p}_hi") for p in parts)) if len(parts) > 1 else F.col(f"_{parts[0]}_hi")) - 1
    touched = F.sequence(F.floor(F.greatest(first, F.lit(0)) / block), F.floor(F.greatest(last, first, F.lit(0)) / block))
    at = rows.withColumn("_blk", F.floor(F.col(pos) / block).cast("bigint"))
    j = at.join(b.withColumn("_blk", F.explode(touched.cast("array<bigint>"))), on=[*keys, "_blk"], how="inner")
    inside = {p: (F.col(pos) >= F.col(f"_{p}_lo")) & (F.col(pos) < F.col(f"_{p}_hi")) for p in parts}
    hit = inside[parts[0]] if len(parts) == 1 else inside["x"] | inside["y"]
    j = j.where(hit)
    if len(parts) == 1:
        j = j.withColumn("part", F.lit(parts[0]))
    else:
        j = j.withColumn("part", F.explode(F.filter(
            F.array(*(F.when(c, F.lit(p)) for p, c in inside.items())), lambda p: p.isNotNull())))
    is_x = F.col("part") == "x"
    chan = [F.when(is_x, F.col(c).cast("double")).alias(c) for c in cols]
    data = j.select(
        *keys, "part",
        F.when(is_x, F.col(pos) - F.col("_x_lo") + F.col("_x_off"))
         .otherwise(F.col(pos) - F.col("_y_lo") + F.col("_y_off")).cast("bigint").alias("step"),
        F.col(target).cast("double").alias("value"),
        F.when(is_x, F.col("_x_m")).otherwise(F.col("_y_m")).alias("mask"),
        *chan, *carry)
    # pad slots: x left pad [0, x_off) and, of a short head, right pad [x_off + len, seq);
    # y left pad [0, y_off) and right pad [y_off + len, label + pred)
    def span(lo: Column, hi: Column) -> Column:
        return F.when(lo < hi, F.sequence(lo.cast("bigint"), (hi - 1).cast("bigint")))

    xlen = F.col("_x_off") + F.greatest(F.col("_x_hi") - F.col("_x_lo"), F.lit(0))
    ylen = F.col("_y_off") + F.greatest(F.col("_y_hi") - F.col("_y_lo"), F.lit(0))
    x_pad_l, x_pad_r = span(F.lit(0), F.col("_x_off")), span(xlen, F.col("_x_len"))
    y_pad_l, y_pad_r = span(F.lit(0), F.col("_y_off")), span(ylen, F.col("_y_len"))
    empty = F.array().cast("array<bigint>")
    both = {"x": (x_pad_l, x_pad_r), "y": (y_pad_l, y_pad_r)}
    pads = b.select(*keys, *carry, F.explode(F.concat(*(
        F.transform(F.concat(*(F.coalesce(x, empty) for x in both[p])),
                    _slot_of(p)) for p in parts)
    )).alias("p")).select(
        *keys, F.col("p.part").alias("part"), F.col("p.step").alias("step"), F.lit(0.0).alias("value"),
        F.lit(0.0).alias("mask"),
        *[F.when(F.col("p.part") == "x", F.lit(0.0)).alias(c) for c in cols], *carry)
    return data.unionByName(pads)


def last_windows(df: DataFrame, lengths: DataFrame, keys: Sequence[str], value: str, seq: int,
                 pos: str = "pos", n: str = "n", block: int = 1 << 16) -> DataFrame:
    """Last ``seq`` values of every series, right-aligned, mask 1 on data, left pad 0."""
    keys = list(keys)
    b = lengths.select(*keys, F.greatest(F.col(n) - seq, F.lit(0)).alias("_lo"), F.col(n).alias("_hi"),
                       (F.lit(seq) - F.least(F.col(n), F.lit(seq))).alias("_off"))
    # rows meet their window by (series, block), as in cut_windows
    touched = b.withColumn("_blk", F.explode(F.sequence(
        F.floor(F.col("_lo") / block), F.floor(F.greatest(F.col("_hi") - 1, F.col("_lo")) / block)).cast("array<bigint>")))
    at = df.select(*keys, pos, value).withColumn("_blk", F.floor(F.col(pos) / block).cast("bigint"))
    data = (at.join(touched, on=[*keys, "_blk"]).where(F.col(pos) >= F.col("_lo"))
            .select(*keys, (F.col(pos) - F.col("_lo") + F.col("_off")).cast("bigint").alias("step"),
                    F.col(value).cast("double").alias("value"), F.lit(1.0).alias("mask")))
    pads = (b.where(F.col("_off") > 0)
            .select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("_off") - 1).cast("bigint"))).alias("step"))
            .select(*keys, "step", F.lit(0.0).alias("value"), F.lit(0.0).alias("mask")))
    return data.unionByName(pads)


def to_arrays(long_df: DataFrame, keys: Sequence[str], cols: Sequence[str] = ("value", "mask"),
              part: str | None = "part") -> DataFrame:
    """Gather long-form slots into arrays per window (bounded by window length)."""
    by = list(keys) + ([part] if part else [])
    s = F.sort_array(F.collect_list(F.struct(F.col("step"), *[F.col(c) for c in cols])))
    g = long_df.groupBy(*by).agg(s.alias("_s"))
    return g.select(*by, *[F.col("_s")[c].alias(c) for c in cols])


def _slot_of(part: str):
    return lambda s: F.struct(F.lit(part).alias("part"), s.alias("step"))


def window_arrays(long_df: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """One row per window ``(keys, x, x_mask, y, y_mask, extra...)`` from its long form, in one shuffle.
    Arrays are bounded by the window length; ``extra`` columns are constant per window."""
    def side(part: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("step", "value", "mask"))))
    g = long_df.groupBy(*keys).agg(side("x").alias("_x"), side("y").alias("_y"), *(F.first(c).alias(c) for c in extra))
    return g.select(*keys, *(F.col(f"_{p}")[f].alias(n) for p in "xy"
                             for f, n in (("value", p), ("mask", f"{p}_mask"))), *extra)


# ---------------------------------------------------------------- sliding windows
def sliding_windows(df: DataFrame, keys: Sequence[str], value: str, seq: int, label: int, pred: int,
                    pos: str = "pos", block: int | None = 1 << 16, extra: Sequence[str] = ()) -> DataFrame:
    """Stride-1 windows per series: x = [s, s+seq), y = [s+seq-label, s+seq+pred).

    Output ``(keys, window_id=s, x, y[, <extra>_x, <extra>_y])``.  ``block`` (None: off) is the
    size of halo blocks, at least a window: positions are cut into blocks of ``block`` rows, each row is also
    copied into the block before it when a window starting there reaches it, and
    windows are kept only in the block they start in -- so one long series runs
    as many tasks instead of one.
    """
    keys = list(keys)
    W = seq + pred
    src = df.select(*keys, pos, value, *extra)
    part_cols = list(keys)
    if block is not None:
        block = max(block, W)
        # row at pos belongs to blocks floor((pos-W+1)/block) .. floor(pos/block)
        lo = F.floor((F.col(pos) - (W - 1)) / block).cast("bigint")
        hi = F.floor(F.col(pos) / block).cast("bigint")
        src = src.withColumn("_blk", F.explode(F.sequence(F.greatest(lo, F.lit(0).cast("bigint")), hi)))
        part_cols.append("_blk")
    w = Window.partitionBy(*part_cols).orderBy(pos).rowsBetween(0, W - 1)
    framed = src.select(*part_cols, pos, F.collect_list(value).over(w).alias("_f"),
                        *[F.collect_list(e).over(w).alias(f"_f_{e}") for e in extra])
    framed = framed.where(F.size("_f") == W)
    if block is not None:
        framed = framed.where(F.floor(F.col(pos) / block) == F.col("_blk"))
    out = [*keys, F.col(pos).cast("bigint").alias("window_id"),
           F.slice("_f", 1, seq).alias("x"), F.slice("_f", seq - label + 1, label + pred).alias("y")]
    for e in extra:
        out += [F.slice(f"_f_{e}", 1, seq).alias(f"{e}_x"), F.slice(f"_f_{e}", seq - label + 1, label + pred).alias(f"{e}_y")]
    return framed.select(*out)


def explode_windows(w: DataFrame, keys: Sequence[str], arrays: Sequence[str] = ("x", "y"),
                    window_id: str = "window_id") -> DataFrame:
    """Array windows -> long ``(keys, window_id, part, step, value)``."""
    parts = [F.struct(F.lit(a).alias("part"), F.col(a).alias("arr")) for a in arrays]
    e = w.select(*keys, window_id, F.explode(F.array(*parts)).alias("_p"))
    return e.select(*keys, window_id, F.col("_p.part").alias("part"),
                    F.posexplode("_p.arr").alias("step", "value")).withColumn("step", F.col("step").cast("bigint"))


# ---------------------------------------------------------------- decoder input / patches
def decoder_input(arr: Column, label: int, pred: int) -> Column:
    """First ``label`` values of y followed by ``pred`` zeros."""
    return F.concat(F.slice(arr, 1, label), F.array_repeat(F.lit(0.0), pred))


def decoder_input_from_x(x: Column, label: int, pred: int) -> Column:
    """M4 variant: last ``label`` values of x followed by ``pred`` zeros."""
    return F.concat(F.slice(x, -label, label), F.array_repeat(F.lit(0.0), pred))


def patch_count(length: int, patch_len: int, stride: int) -> int:
    return (length + stride - patch_len) // stride + 1


def patches(arr: Column, length: int, patch_len: int, stride: int) -> Column:
    """End-replication pad by ``stride`` copies of the last value, then patches of
    ``patch_len`` every ``stride`` -> array of arrays.  A mask is cut by the same call."""
    padded = F.concat(arr, F.array_repeat(F.element_at(arr, -1), stride))
    k = patch_count(length, patch_len, stride)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice(padded, i * stride + 1, patch_len))
