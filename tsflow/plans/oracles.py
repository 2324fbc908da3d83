"""DuckDB oracle SQL for the registered queries (same fixtures, same parameters).

Written independently of the Spark plans: windows as range joins, positions as
plain ``row_number``, hashes with DuckDB's md5.  ``fc_linear_full`` has no oracle (a
least-squares solve with many inputs); it is checked against numpy in the tests.
"""

from __future__ import annotations

import math

from tsflow.plans import queries as Q
from tsflow.plans.fixtures_sql import cte, h, with_ctes

KEYS = Q.KEYS
CH = Q.CH
D = "CAST({} AS DOUBLE)".format
HOURLY = [f"{k}_{t}" for k in "nv" for t in ("click", "error", "purchase", "signup", "view", "other")]
DAILY = ["px", "p1", "p2", "p3", "p4", "ot"]


def _k(alias: str, keys) -> str:
    return ", ".join(f"{alias}.{k}" for k in keys)


# sizes are numbers or SQL expressions over the series (M4 groups)
def cuts_sql(src: str, keys, mode: str, seq, pred) -> str:
    if mode == "cut":
        lo, hi = f"{seq}", f"n - {pred}"
    elif mode == "masked":
        lo, hi = f"greatest(1, n - {int(pred * Q.RATE)})", "n"
    elif mode == "m4":
        lo, hi = f"greatest(1, n - CAST(floor({D(repr(Q.HIST))} * ({pred})) AS BIGINT))", "n"
    elif mode == "head":
        return f"SELECT *, CAST({seq} AS BIGINT) AS cut FROM {src}"
    return (f"SELECT *, CASE WHEN ({hi}) - ({lo}) > 0 THEN CAST(({lo}) + ({h('cut', list(keys))} % (({hi}) - ({lo}))) "
            f"AS BIGINT) END AS cut FROM {src}")


def bounds_sql(cuts: str, mode: str, seq, label, pred, align: str = "reference") -> str:
    off, y_off = "0", "0"
    if mode == "cut":
        e = f"cut - {seq} AS x_lo, cut AS x_hi, cut - {label} AS y_lo, cut + {pred} AS y_hi, 0.0 AS xm, 0.0 AS ym"
    elif mode == "masked":
        first = 1 if align == "reference" else 0
        e = (f"greatest(0, cut - {seq}) AS x_lo, cut AS x_hi, greatest({first}, cut - {label}) AS y_lo, "
             f"least(n, cut + {pred}) AS y_hi, 1.0 AS xm, 1.0 AS ym")
        off = f"{seq} - (x_hi - x_lo)"
        if align == "cut":
            y_off = f"y_lo - (cut - {label})"
    elif mode == "head":
        e = (f"0 AS x_lo, least(n, {seq}) AS x_hi, {seq} - {label} AS y_lo, least(n, {seq} + {pred}) AS y_hi, "
             f"0.0 AS xm, 1.0 AS ym")
    elif mode == "m4":
        e = (f"greatest(0, cut - {seq}) AS x_lo, cut AS x_hi, greatest(0, cut - {label}) AS y_lo, "
             f"least(n, cut + {pred}) AS y_hi, 1.0 AS xm, 1.0 AS ym")
        off = f"{seq} - (x_hi - x_lo)"
    return (f"SELECT *, CAST({off} AS BIGINT) AS x_off, CAST({y_off} AS BIGINT) AS y_off, CAST({seq} AS BIGINT) AS x_len, "
            f"CAST({label} + {pred} AS BIGINT) AS y_len, CAST(xm AS DOUBLE) AS x_m, CAST(ym AS DOUBLE) AS y_m "
            f"FROM (SELECT *, {e} FROM ({cuts}) WHERE cut IS NOT NULL)")


def windows_sql(rows: str, cuts: str, keys, target: str, mode: str, seq, label, pred,
                cols=(), align: str = "reference") -> str:
    b = f"({bounds_sql(cuts, mode, seq, label, pred, align)})"
    on = " AND ".join(f"c.{k} = w.{k}" for k in keys)
    ks = ", ".join(keys)
    out = []
    for part in "xy":
        mine = part == "x"
        cx = "".join(f", {D('c.' + c) if mine else 'CAST(NULL AS DOUBLE)'} AS {c}" for c in cols)
        cz = "".join(f", CAST({'0' if mine else 'NULL'} AS DOUBLE) AS {c}" for c in cols)
        out.append(f"""
    SELECT {_k('w', keys)}, '{part}' AS part, CAST(c.pos - w.{part}_lo + w.{part}_off AS BIGINT) AS step,
           {D('c.' + target)} AS value, w.{part}_m AS mask{cx}
    FROM {b} w JOIN {rows} c ON {on} AND c.pos >= w.{part}_lo AND c.pos < w.{part}_hi""")
        for lo, hi in (("0", f"{part}_off"), (f"{part}_off + greatest({part}_hi - {part}_lo, 0)", f"{part}_len")):
            out.append(f"""
    SELECT {ks}, '{part}' AS part, CAST(step AS BIGINT) AS step, CAST(0 AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS mask{cz}
    FROM (SELECT {ks}, unnest(range({lo}, {hi})) AS step FROM {b})""")
    return " UNION ALL ".join(out)


U_SEQ, U_LABEL, U_PRED = Q.UNMASKED
M_SEQ, M_LABEL, M_PRED = Q.MASKED

# ---------------------------------------------------------------- shared CTEs
cte("cuts_cut", ["sg"], cuts_sql("sg", KEYS, "cut", U_SEQ, U_PRED))
cte("cuts_masked", ["sg"], cuts_sql("sg", KEYS, "masked", M_SEQ, M_PRED))
cte("cuts_head", ["sg"], cuts_sql("sg", KEYS, "head", Q.HEAD[0], Q.HEAD[2]))
cte("w_cut", ["cycles", "cuts_cut"], windows_sql("cycles", "cuts_cut", KEYS, "target", "cut", *Q.UNMASKED, cols=CH))
cte("w_masked", ["cycles", "cuts_masked"],
    windows_sql("cycles", "cuts_masked", KEYS, "target", "masked", *Q.MASKED, cols=CH))
cte("w_head", ["cycles", "cuts_head"], windows_sql("cycles", "cuts_head", KEYS, "target", "head", *Q.HEAD))
cte("mx", ["w_masked"], "SELECT battery_id, cycle_index, step, value FROM w_masked WHERE part = 'x'")
def fc_sql(w: str, label: int) -> str:
    return f"""
  SELECT y.battery_id, y.cycle_index, g.split, CAST(floor(g.split_rank / {Q.BS}) AS BIGINT) AS batch_id,
         g.split_rank AS window_id, CAST(y.step - {label} AS BIGINT) AS step, y.value AS y, m.yhat, y.mask
  FROM {w} y
  JOIN (SELECT battery_id, cycle_index, list_reduce(list(value ORDER BY step), lambda a, b: a + b) / count(*) AS yhat FROM {w} WHERE part = 'x' GROUP BY 1, 2) m
    USING (battery_id, cycle_index)
  JOIN sg g USING (battery_id, cycle_index)
  WHERE y.part = 'y' AND y.step >= {label}"""


cte("fc", ["w_masked", "sg"], fc_sql("w_masked", M_LABEL))
cte("fcp", ["w_cut", "sg"], fc_sql("w_cut", U_LABEL))
cte("melt", ["hourly"], f"""
  SELECT pos, channel, value FROM hourly UNPIVOT (value FOR channel IN ({', '.join(HOURLY)}))""")
cte("dsplit_train", ["daily"], f"SELECT * FROM daily WHERE pos >= 0 AND pos < {Q.BORDERS[0]}")
cte("dscaler", ["dsplit_train"], "SELECT " + ", ".join(
    [f"avg({c}) AS mean_{c}" for c in DAILY]
    + [f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS std_{c}" for c in DAILY])
    + " FROM dsplit_train")
cte("dscaled", ["daily", "dscaler"], "SELECT pos, " + ", ".join(
    f"({c} - mean_{c}) / std_{c} AS {c}" for c in DAILY) + " FROM daily, dscaler")
cte("mx_stats", ["mx"], """
  SELECT battery_id, cycle_index, avg(value) AS rv_mean, sqrt(var_pop(value) + 1e-5) AS rv_std,
         arg_max(value, step) AS rv_last FROM mx GROUP BY 1, 2""")
cte("mx_norm", ["mx", "mx_stats"], """
  SELECT battery_id, cycle_index, step, (value - rv_mean) / rv_std AS value, rv_mean, rv_std, rv_last
  FROM mx JOIN mx_stats USING (battery_id, cycle_index)""")

# every window of ev (L = 24), raw and normalised
EV_L = Q.EV_L
cte("ev_n", ["ev"], "SELECT series_id, count(*) AS n FROM ev GROUP BY 1")
cte("evw", ["ev", "ev_n"], f"""
  SELECT s.series_id, s.pos AS window_id, CAST(e.pos - s.pos AS BIGINT) AS step, e.value
  FROM ev s JOIN ev_n n USING (series_id) JOIN ev e ON e.series_id = s.series_id AND e.pos >= s.pos AND e.pos < s.pos + {EV_L}
  WHERE s.pos + {EV_L} <= n.n""")
cte("evw_norm", ["evw"], """
  SELECT series_id, window_id, step, (value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5) AS value
  FROM evw WINDOW w AS (PARTITION BY series_id, window_id)""")
cte("ev_arr", ["evw_norm"], """
  SELECT series_id, window_id, list(value ORDER BY step) AS x FROM evw_norm GROUP BY 1, 2""")


def autocorr_sql(src: str, keys: str, length: int) -> str:
    return f"""
  SELECT {keys}, lag, list_sum(list_transform(range({length}), lambda i: x[i + 1] * x[(i + lag) % {length} + 1])) AS r
  FROM {src}, (SELECT unnest(range({length})) AS lag)"""


cte("ev_ac", ["ev_arr"], autocorr_sql("ev_arr", "series_id, window_id", EV_L))
cte("ev_top", ["ev_ac"], """
  SELECT series_id, window_id, lag, r,
         CAST(row_number() OVER (PARTITION BY series_id, window_id ORDER BY round(-r, 9), lag) - 1 AS BIGINT) AS rank
  FROM ev_ac""")

# M4 parts
cte("m4_train", ["m4c"], "SELECT * FROM m4c WHERE part = 'train'")
cte("m4_test", ["m4c"], "SELECT id, CAST(pos - greatest(n - horizon, 0) AS BIGINT) AS step, value AS y FROM m4c WHERE part = 'test'")
cte("m4_info", ["m4c"], "SELECT DISTINCT id, grp FROM m4c")
cte("m4_model", ["m4_train", "m4_test"], """
  SELECT t.id, t.step, m.yhat FROM m4_test t JOIN (SELECT id, avg(value) AS yhat FROM m4_train GROUP BY 1) m USING (id)""")
cte("m4_base", ["m4_train", "m4_test"], """
  SELECT t.id, t.step, m.yhat FROM m4_test t JOIN (SELECT id, arg_max(value, pos) AS yhat FROM m4_train GROUP BY 1) m
  USING (id)""")
cte("m4_masep", ["m4_train"], """
  SELECT a.id, avg(abs(a.value - b.value)) AS masep FROM m4_train a JOIN m4_train b ON a.id = b.id AND a.pos = b.pos + a.freq
  GROUP BY 1""")


def m4_scores_sql(fc: str) -> str:
    return f"""
    SELECT grp, sum(s) / sum(np) AS smape, sum(mp) / sum(np) AS mape, avg(CASE WHEN masep = 0 THEN NULL ELSE mae / masep END) AS mase,
           count(*) AS n_series, CAST(sum(nt) - sum(np) AS BIGINT) AS n_missing
    FROM (SELECT i.grp, t.id, avg(abs(f.yhat - t.y)) AS mae,
                 sum(200 * abs(f.yhat - t.y) / CASE WHEN abs(t.y) + abs(f.yhat) = 0 THEN 1.0 ELSE abs(t.y) + abs(f.yhat) END) AS s,
                 sum(100 * abs(f.yhat - t.y) / CASE WHEN abs(t.y) = 0 THEN 1.0 ELSE abs(t.y) END) AS mp,
                 count(f.yhat) AS np, count(*) AS nt
          FROM m4_test t LEFT JOIN {fc} f USING (id, step) JOIN m4_info i USING (id)
          GROUP BY 1, 2) s
    LEFT JOIN m4_masep USING (id)
    GROUP BY 1"""


cte("m4_scores_model", ["m4_test", "m4_model", "m4_info", "m4_masep"], m4_scores_sql("m4_model"))
cte("m4_scores_base", ["m4_test", "m4_base", "m4_info", "m4_masep"], m4_scores_sql("m4_base"))
MAIN = ", ".join(f"'{g}'" for g in Q.fx.M4_MAIN_GROUPS)


def regroup_sql(src: str) -> str:
    return f"""
    SELECT coalesce(c, 'Average') AS grp, sum(smape * n_series) / sum(n_series) AS smape,
           sum(mape * n_series) / sum(n_series) AS mape, sum(mase * n_series) / sum(n_series) AS mase,
           CAST(sum(n_series) AS BIGINT) AS n_series
    FROM (SELECT *, CASE WHEN grp IN ({MAIN}) THEN grp ELSE 'Others' END AS c FROM {src})
    GROUP BY ROLLUP (c)"""


cte("m4_rg_model", ["m4_scores_model"], regroup_sql("m4_scores_model"))
cte("m4_rg_base", ["m4_scores_base"], regroup_sql("m4_scores_base"))


def result_sql(name: str, mode: str, seq: int, label: int, pred: int, masked: bool) -> None:
    w = "w_masked" if masked else "w_cut"
    v = "value * mask" if masked else "value"
    cte(name, [w, "sg"], f"""
      WITH t AS (SELECT battery_id, cycle_index, split_rank AS batch, CAST(0 AS BIGINT) AS seq FROM sg WHERE split = 'test'),
           x AS (SELECT * FROM {w} JOIN t USING (battery_id, cycle_index) WHERE part = 'x'),
           yy AS (SELECT * FROM {w} JOIN t USING (battery_id, cycle_index) WHERE part = 'y' AND step >= {label}),
           m AS (SELECT batch, seq, list_reduce(list(value ORDER BY step), lambda a, b: a + b) / count(*) AS yhat FROM x GROUP BY 1, 2)
      SELECT batch, seq, CAST(step AS BIGINT) AS id, {v} AS y, {v} AS yhat, mask FROM x
      UNION ALL
      SELECT yy.batch, yy.seq, CAST(yy.step - {label} + {seq} AS BIGINT) AS id, {v} AS y, m.yhat, yy.mask
      FROM yy JOIN m USING (batch, seq)""")


result_sql("res", "cut", *Q.UNMASKED, masked=False)
result_sql("res_masked", "masked", *Q.MASKED, masked=True)
cte("res_dif", ["res"], "SELECT batch, seq, id, y, yhat, y - yhat AS dif FROM res")


def q(needed, body):
    return with_ctes(needed, body)


def _split_rows(ranges) -> str:
    parts = [f"SELECT pos, '{s}' AS split, ot FROM daily WHERE pos >= {lo} AND pos < {hi}" for s, lo, hi in ranges]
    return " UNION ALL ".join(parts)


SMAPE = "200 * avg(CASE WHEN abs(yhat) + abs(y) = 0 THEN 0 ELSE abs(yhat - y) / (abs(yhat) + abs(y)) END * mask)"
EPSB = ("avg((yhat - y) * (yhat - y)) AS mse, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, "
        "avg(abs(yhat - y) / (y + 1e-8)) AS mape, avg(power(abs(yhat - y) / (y + 1e-8), 2)) AS mspe")
MASKB = ("sum((yhat - y) * (yhat - y) * mask) / sum(mask) AS mse, sum(abs(yhat - y) * mask) / sum(mask) AS mae, "
         "sqrt(sum((yhat - y) * (yhat - y) * mask) / sum(mask)) AS rmse, "
         "sum(abs(yhat - y) / (y + 1e-8) * mask) / sum(mask) AS mape, "
         "avg(power(abs(yhat - y) / (y + 1e-8), 2) * mask) AS mspe")
SEQ_END = U_SEQ + U_PRED - 1
K = math.log(10000.0) / Q.SINCOS_D


def sincos_sql(pos: str) -> str:
    return (f"CASE WHEN j % 2 = 0 THEN sin({pos} * exp(-(j - j % 2) * CAST({K!r} AS DOUBLE))) "
            f"ELSE cos({pos} * exp(-(j - j % 2) * CAST({K!r} AS DOUBLE))) END")


def ma_sql(src: str, k: int, name: str) -> str:
    hh = (k - 1) // 2
    return f"""
      SELECT series_id, pos, value,
        (sum(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {hh} PRECEDING AND {hh} FOLLOWING)
         + greatest(0, {hh} - pos) * first_value(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
         + greatest(0, {hh} - (count(*) OVER (PARTITION BY series_id) - 1 - pos))
           * last_value(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        ) / {float(k)!r} AS {name}
      FROM {src}"""


ORACLES: dict[str, str] = {
    "scan_wide": q(["daily"], "SELECT CAST(date AS VARCHAR) AS date, pos, px, p1, p2, p3, p4, ot FROM daily"),
    "scan_cycles": q(["cycles"], "SELECT * FROM cycles"),
    "m4_load": q(["m4c"], "SELECT id, grp, freq, horizon, pos, value, part FROM m4c"),
    "m4_group": q(["m4c"], "SELECT id, pos, value, freq FROM m4c WHERE grp = 'BUILDING'"),
    "m4_forecast_file": q(["m4_base"], "SELECT id, step, yhat FROM m4_base"),
    "feature_modes": q(["daily"], " UNION ALL ".join(
        f"SELECT CAST(date AS VARCHAR) AS date, pos, {i} AS slot, {c} AS value FROM daily" for i, c in enumerate(["p1", "p2", "p3", "p4", "px", "ot"]))),
    "long_cycles": q(["cycles", "kept"], "SELECT battery_id, cycle_index, pos, n FROM cycles JOIN kept USING (battery_id, cycle_index)"),
    "melt_channels": q(["melt"], "SELECT pos, channel, value FROM melt"),
    "horizon_slice": q(["w_cut"], f"""SELECT battery_id, cycle_index, CAST(step - {U_LABEL} AS BIGINT) AS h, value
                                      FROM w_cut WHERE part = 'y' AND step >= {U_LABEL}"""),
    # borders written out: train ends at 600, val at 800, test at 1000, 96 rows of lookback
    "split_fixed": q(["daily"], _split_rows([("train", 0, 600), ("val", 504, 800), ("test", 704, 1000)])),
    "split_pretrain": q(["daily"], _split_rows([("train", 0, 800), ("val", 704, 1000), ("test", 704, 1000)])),
    "split_percent": q(["daily"], _split_rows([("train", 0, 146), ("val", 504, 800), ("test", 704, 1000)])),
    "split_quarter": """
        WITH g AS (SELECT time_bucket(INTERVAL 15 minutes, ts) AS t, count(*) AS n FROM events GROUP BY 1),
             r AS (SELECT row_number() OVER (ORDER BY t) - 1 AS pos, n FROM g)
        SELECT pos, 'train' AS split, n FROM r WHERE pos < 800
        UNION ALL SELECT pos, 'val', n FROM r WHERE pos >= 704 AND pos < 1120
        UNION ALL SELECT pos, 'test', n FROM r WHERE pos >= 1024 AND pos < 1440""",
    "batches_full": q(["sg"], f"""
        SELECT battery_id, cycle_index, split, CAST(floor(split_rank / {Q.BS}) AS BIGINT) AS batch_id, CAST(split_rank % {Q.BS} AS BIGINT) AS batch_seq
        FROM (SELECT *, count(*) OVER (PARTITION BY split) AS c FROM sg) WHERE floor(split_rank / {Q.BS}) < floor(c / {Q.BS})"""),
    "split_ratio": q(["daily"], f"""
        WITH c AS (SELECT count(*) AS n FROM daily),
             b AS (SELECT n, floor(CAST(0.7 AS DOUBLE) * n) AS ntr, floor(CAST(0.2 AS DOUBLE) * n) AS nte FROM c)
        SELECT pos, 'train' AS split, ot FROM daily, b WHERE pos >= 0 AND pos < ntr
        UNION ALL SELECT pos, 'val', ot FROM daily, b WHERE pos >= ntr - {Q.DAILY_L} AND pos < n - nte
        UNION ALL SELECT pos, 'test', ot FROM daily, b WHERE pos >= n - nte - {Q.DAILY_L} AND pos < n"""),
    "split_groups": q(["sg"], "SELECT battery_id, cycle_index, split, rank, split_rank FROM sg"),
    "cut_points": q(["kept"], "SELECT battery_id, cycle_index, n, cut FROM (" + cuts_sql("kept", KEYS, "masked", M_SEQ, M_PRED) + ")"),
    "batches": q(["sg"], f"""
        SELECT battery_id, cycle_index, split, CAST(floor(split_rank / {Q.BS}) AS BIGINT) AS batch_id,
               CAST(split_rank % {Q.BS} AS BIGINT) AS batch_seq,
               floor(split_rank / {Q.BS}) < floor(count(*) OVER (PARTITION BY split) / {Q.BS}) AS full_batch
        FROM sg"""),
    "scaler_fit": q(["dscaler"], "SELECT * FROM dscaler"),
    "scaler_apply": q(["dscaled"], "SELECT * FROM dscaled"),
    "scaler_inverse": q(["daily", "dscaler"], "SELECT pos, " + ", ".join(f"{c} + std_{c} AS {c}" for c in DAILY) + " FROM daily, dscaler"),
    "scaler_transfer": q(["daily"], f"""
        WITH a AS (SELECT avg(p1) AS m, stddev_pop(p1) AS sd FROM daily WHERE pos < {Q.BORDERS[0]}) SELECT pos, (ot - m) / sd AS v FROM daily, a"""),
    "revin_affine": q(["mx_norm"], "SELECT battery_id, cycle_index, step, value * 2.0 + 0.5 AS value FROM mx_norm"),
    "revin_off": q(["mx", "mx_stats"], "SELECT battery_id, cycle_index, step, value, rv_last FROM mx JOIN mx_stats USING (battery_id, cycle_index)"),
    "revin_denorm_affine": q(["mx", "mx_stats"], """SELECT battery_id, cycle_index, step,
        (((value - rv_last) / rv_std * 2.0 + 0.5) + 1 - 0.5) / (2.0 + 1e-10) * rv_std + rv_last AS value FROM mx JOIN mx_stats USING (battery_id, cycle_index)"""),
    "revin_norm": q(["mx_norm"], "SELECT battery_id, cycle_index, step, value FROM mx_norm"),
    "revin_last": q(["mx", "mx_stats"], """SELECT battery_id, cycle_index, step, (value - rv_last) / rv_std AS value
                                            FROM mx JOIN mx_stats USING (battery_id, cycle_index)"""),
    "revin_denorm": q(["mx", "mx_stats"], """SELECT battery_id, cycle_index, step, 2 * value - rv_mean + rv_std AS value
                                             FROM mx JOIN mx_stats USING (battery_id, cycle_index)"""),
    "sliding_windows": q(["melt"], f"""
        WITH nn AS (SELECT channel, count(*) AS n FROM melt GROUP BY 1),
             s AS (SELECT m.channel, m.pos AS s FROM melt m JOIN nn USING (channel) WHERE m.pos + {sum(Q.SLIDE[::2])} <= nn.n)
        SELECT s.channel, s.s AS window_id, 'x' AS part, CAST(b.pos - s.s AS BIGINT) AS step, b.value
        FROM s JOIN melt b ON b.channel = s.channel AND b.pos >= s.s AND b.pos < s.s + {Q.SLIDE[0]}
        UNION ALL
        SELECT s.channel, s.s, 'y', CAST(b.pos - (s.s + {Q.SLIDE[0] - Q.SLIDE[1]}) AS BIGINT), b.value
        FROM s JOIN melt b ON b.channel = s.channel AND b.pos >= s.s + {Q.SLIDE[0] - Q.SLIDE[1]}
             AND b.pos < s.s + {Q.SLIDE[0] + Q.SLIDE[2]}"""),
    "window_marks": q(["daily"], f"""
        WITH s AS (SELECT pos AS s FROM daily WHERE pos + {Q.MARKS[0] + Q.MARKS[2]} <= (SELECT count(*) FROM daily)),
             d AS (SELECT pos, ot, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
                          CAST(isodow(date) - 1 AS INTEGER) AS weekday FROM daily)
        SELECT s.s AS window_id, 'x' AS part, CAST(d.pos - s.s AS BIGINT) AS step, d.ot AS value, month, day, weekday
        FROM s JOIN d ON d.pos >= s.s AND d.pos < s.s + {Q.MARKS[0]}
        UNION ALL
        SELECT s.s, 'y', CAST(d.pos - (s.s + {Q.MARKS[0] - Q.MARKS[1]}) AS BIGINT), d.ot, month, day, weekday
        FROM s JOIN d ON d.pos >= s.s + {Q.MARKS[0] - Q.MARKS[1]} AND d.pos < s.s + {Q.MARKS[0] + Q.MARKS[2]}"""),
    "cut_windows": q(["w_cut"], "SELECT * FROM w_cut"),
    "masked_windows": q(["w_masked"], "SELECT * FROM w_masked"),
    "head_windows": q(["w_head"], "SELECT * FROM w_head"),
    "masked_windows_cut": q(["cycles", "cuts_masked"], windows_sql("cycles", "cuts_masked", KEYS, "target", "masked", *Q.MASKED, align="cut")),
    "decoder_input_m4": q(["mx"], f"""
        SELECT battery_id, cycle_index, CAST(step - {M_SEQ - M_LABEL} AS BIGINT) AS step, value FROM mx WHERE step >= {M_SEQ - M_LABEL}
        UNION ALL SELECT battery_id, cycle_index, CAST({M_LABEL} + k AS BIGINT), 0.0
        FROM (SELECT DISTINCT battery_id, cycle_index FROM mx), (SELECT unnest(range({M_PRED})) AS k)"""),
    "decoder_input": q(["w_masked"], f"""SELECT battery_id, cycle_index, step,
                                           CASE WHEN step < {M_LABEL} THEN value ELSE 0.0 END AS value
                                           FROM w_masked WHERE part = 'y'"""),
    "patches": q(["mx"], f"""
        WITH padded AS (SELECT battery_id, cycle_index, step AS slot, value FROM mx
                        UNION ALL
                        SELECT battery_id, cycle_index, {M_SEQ} + k, value
                        FROM mx, (SELECT unnest(range({Q.PATCH[1]})) AS k) WHERE step = {M_SEQ - 1}),
             pp AS (SELECT battery_id, cycle_index, slot, value,
                           unnest(range(CAST(greatest(0, ceil((slot - {Q.PATCH[0] - 1}) / {Q.PATCH[1]})) AS BIGINT),
                                        CAST(least({(M_SEQ + Q.PATCH[1] - Q.PATCH[0]) // Q.PATCH[1]}, floor(slot / {Q.PATCH[1]})) AS BIGINT) + 1)) AS patch_id
                    FROM padded)
        SELECT battery_id, cycle_index, CAST(patch_id AS BIGINT) AS patch_id,
               CAST(slot - patch_id * {Q.PATCH[1]} AS BIGINT) AS j, value FROM pp"""),
    "length_histogram": q(["clen"], "SELECT n AS len, count(*) AS n_series FROM clen GROUP BY 1"),
    "window_rejects": q(["clen"], f"""SELECT battery_id, cycle_index, n, CAST({M_SEQ} AS BIGINT) AS low,
                                        CAST(n - {M_PRED} AS BIGINT) AS high FROM clen WHERE {M_SEQ} >= n - {M_PRED}"""),
    "calendar_marks": q(["ev"], """
        SELECT series_id, pos, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
               CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour,
               CAST(floor(minute(ts) / 15) AS INTEGER) AS minute FROM ev"""),
    "time_features": q(["ev"], """
        SELECT series_id, pos, minute(ts) / CAST(59 AS DOUBLE) - 0.5 AS minute_of_hour,
               hour(ts) / CAST(23 AS DOUBLE) - 0.5 AS hour_of_day,
               (isodow(ts) - 1) / CAST(6 AS DOUBLE) - 0.5 AS day_of_week,
               (day(ts) - 1) / CAST(30 AS DOUBLE) - 0.5 AS day_of_month,
               (dayofyear(ts) - 1) / CAST(365 AS DOUBLE) - 0.5 AS day_of_year FROM ev"""),
    "sincos_position": q(["hourly"], f"""
        SELECT pos, CAST(j AS BIGINT) AS j, {sincos_sql('pos')} AS value
        FROM hourly, (SELECT unnest(range({Q.SINCOS_D})) AS j)"""),
    "sincos_calendar": q(["hourly"], f"""
        SELECT pos, CAST(j AS BIGINT) AS j,
               {sincos_sql('hour(hour_ts)')} + {sincos_sql('(isodow(hour_ts) - 1)')}
               + {sincos_sql('day(hour_ts)')} + {sincos_sql('month(hour_ts)')} AS value
        FROM hourly, (SELECT unnest(range({Q.SINCOS_D})) AS j)"""),
    "moving_avg": q(["ev"], f"SELECT series_id, pos, trend FROM ({ma_sql('ev', Q.MA_K, 'trend')})"),
    "decompose": q(["ev"], f"SELECT series_id, pos, trend, value - trend AS seasonal FROM ({ma_sql('ev', Q.MA_K, 'trend')})"),
    "decompose_multi": q(["ev"], f"""
        SELECT a.series_id, a.pos, (a.t1 + b.t2) / 2 AS trend, a.value - (a.t1 + b.t2) / 2 AS seasonal
        FROM ({ma_sql('ev', Q.MULTI_K[0], 't1')}) a JOIN ({ma_sql('ev', Q.MULTI_K[1], 't2')}) b USING (series_id, pos)"""),
    "decomp_init": q(["mx"], f"""
        WITH t AS (SELECT a.battery_id, a.cycle_index, a.step, a.value,
                          list_reduce(list(b.value ORDER BY oo.o), lambda p, q: p + q) / {float(Q.MA_K)!r} AS trend
                   FROM mx a JOIN (SELECT unnest(range(-{(Q.MA_K - 1) // 2}, {(Q.MA_K - 1) // 2 + 1})) AS o) oo ON TRUE
                   JOIN mx b ON b.battery_id = a.battery_id AND b.cycle_index = a.cycle_index
                        AND b.step = least(greatest(a.step + oo.o, 0), {M_SEQ - 1})
                   GROUP BY 1, 2, 3, 4),
             m AS (SELECT battery_id, cycle_index, list_reduce(list(value ORDER BY step), lambda a, b: a + b) / count(*) AS mean FROM mx GROUP BY 1, 2)
        SELECT battery_id, cycle_index, 'trend' AS part, CAST(step - {M_SEQ - M_LABEL} AS BIGINT) AS step, trend AS value
        FROM t WHERE step >= {M_SEQ - M_LABEL}
        UNION ALL
        SELECT battery_id, cycle_index, 'trend', CAST({M_LABEL} + k AS BIGINT), mean
        FROM m, (SELECT unnest(range({M_PRED})) AS k)
        UNION ALL
        SELECT battery_id, cycle_index, 'seasonal', CAST(step - {M_SEQ - M_LABEL} AS BIGINT), value - trend
        FROM t WHERE step >= {M_SEQ - M_LABEL}
        UNION ALL
        SELECT battery_id, cycle_index, 'seasonal', CAST({M_LABEL} + k AS BIGINT), 0.0
        FROM m, (SELECT unnest(range({M_PRED})) AS k)"""),
    "autocorr": q(["ev_ac"], "SELECT series_id, window_id, CAST(lag AS BIGINT) AS lag, r FROM ev_ac"),
    "top_lags": q(["ev_top"], f"SELECT series_id, window_id, rank, CAST(lag AS BIGINT) AS lag FROM ev_top WHERE rank < {Q.TOPK}"),
    "period_agg": q(["ev_top", "evw_norm"], f"""
        WITH t AS (SELECT series_id, window_id, lag, r FROM ev_top WHERE rank < {max(1, int(math.log(EV_L)))}),
             e AS (SELECT series_id, window_id, lag, exp(r - max(r) OVER w) AS ex FROM t WINDOW w AS (PARTITION BY series_id, window_id)),
             wt AS (SELECT series_id, window_id, lag, ex / sum(ex) OVER (PARTITION BY series_id, window_id) AS w FROM e)
        SELECT x.series_id, x.window_id, CAST(x.step AS BIGINT) AS t, sum(wt.w * v.value) AS value
        FROM evw_norm x JOIN wt USING (series_id, window_id)
        JOIN evw_norm v ON v.series_id = x.series_id AND v.window_id = x.window_id AND v.step = (x.step + wt.lag) % {EV_L}
        GROUP BY 1, 2, 3"""),
    "align_len": q(["evw"], f"""
        WITH a AS (SELECT series_id, window_id, list(value ORDER BY step) AS x FROM evw GROUP BY 1, 2)
        SELECT series_id, window_id, CAST(t AS BIGINT) AS t, CASE WHEN t < 10 + series_id % 30 THEN x[t + 1] ELSE 0 END AS value
        FROM a, (SELECT unnest(range({EV_L})) AS t)"""),
    "window_stats": q(["evw"], """
        SELECT series_id, window_id, min(value) AS min_value, max(value) AS max_value,
               quantile_disc(value, 0.5) AS median_value,
               CASE WHEN arg_max(value, step) - arg_min(value, step) > 0 THEN 'upward' ELSE 'downward' END AS trend
        FROM evw GROUP BY 1, 2"""),
    "prompt_text": q(["evw_norm", "ev_top"], f"""
        WITH st AS (SELECT series_id, window_id, min(value) AS mn, max(value) AS mx, quantile_disc(value, 0.5) AS md,
                           CASE WHEN arg_max(value, step) - arg_min(value, step) > 0 THEN 'upward' ELSE 'downward' END AS tr
                    FROM evw_norm GROUP BY 1, 2),
             lg AS (SELECT series_id, window_id, '[' || string_agg(CAST(lag AS VARCHAR), ', ' ORDER BY rank) || ']' AS lags
                    FROM ev_top WHERE rank < {Q.TOPK} GROUP BY 1, 2)
        SELECT series_id, window_id,
          '<|start_prompt|>Dataset description: {Q.DESCRIPTION}Task description: forecast the next {M_PRED} steps given the previous {EV_L} steps information; Input statistics: min value '
          || printf('%.4f', mn) || ', max value ' || printf('%.4f', mx) || ', median value ' || printf('%.4f', md)
          || ', the trend of input is ' || tr || ', top 5 lags are : ' || lags || '<|<end_prompt>|>' AS prompt
        FROM st JOIN lg USING (series_id, window_id)"""),
    "point_adjust": q(["anom"], """
        WITH i AS (SELECT *, sum(CASE WHEN gt = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM anom),
             hh AS (SELECT series_id, isl, max(CASE WHEN gt = 1 AND pred = 1 THEN 1 ELSE 0 END) AS hit FROM i GROUP BY 1, 2)
        SELECT series_id, pos, gt, pred,
               CAST(CASE WHEN gt = 1 AND hit = 1 AND pos > 0 THEN 1 ELSE pred END AS INTEGER) AS pred_adj
        FROM i JOIN hh USING (series_id, isl)"""),
    "metrics_basic": q(["fcp"], """
        SELECT split, avg(abs(yhat - y)) AS mae, avg((yhat - y) * (yhat - y)) AS mse,
               sqrt(avg((yhat - y) * (yhat - y))) AS rmse,
               avg(abs((yhat - y) / CASE WHEN y = 0 THEN NULL ELSE y END)) AS mape,
               avg(power((yhat - y) / CASE WHEN y = 0 THEN NULL ELSE y END, 2)) AS mspe,
               count(CASE WHEN y = 0 THEN 1 END) AS n_zero_true
        FROM fcp GROUP BY 1"""),
    "rse": q(["fcp"], "SELECT split, sqrt(sum((y - yhat) * (y - yhat))) / sqrt(var_pop(y) * count(y)) AS rse FROM fcp GROUP BY 1"),
    "corr_ref": q(["fcp"], """
        WITH m AS (SELECT split, step, avg(y) AS mt, avg(yhat) AS mp FROM fcp GROUP BY 1, 2),
             c AS (SELECT split, step, sum((y - mt) * (yhat - mp)) / sqrt(sum(power(y - mt, 2) * power(yhat - mp, 2))) AS c,
                          corr(yhat, y) AS pc
                   FROM fcp JOIN m USING (split, step) GROUP BY 1, 2)
        SELECT split, avg(c) AS corr, avg(pc) AS pearson FROM c GROUP BY 1"""),
    "metrics_eps": q(["fcp"], f"SELECT split, {EPSB} FROM fcp GROUP BY 1"),
    "mape_abs": q(["fcp"], "SELECT split, avg(abs((yhat - y) / (y + 1e-8))) AS mape_abs FROM fcp GROUP BY 1"),
    "metrics_masked": q(["fc"], f"SELECT split, {MASKB}, sum((yhat - y) * (yhat - y) * mask) / sum(mask) AS mse_loss FROM fc GROUP BY 1"),
    "smape_loss": q(["fc"], f"SELECT split, {SMAPE} AS smape_loss FROM fc GROUP BY 1"),
    "mape_loss": q(["fc"], """SELECT split, avg(abs((yhat - y) * CASE WHEN y = 0 THEN 0 ELSE mask / y END)) AS mape_loss
                              FROM fc GROUP BY 1"""),
    "mase_loss": q(["fc", "mx"], """
        WITH sc AS (SELECT a.battery_id, a.cycle_index, avg(abs(a.value - b.value)) AS masep
                    FROM mx a JOIN mx b ON a.battery_id = b.battery_id AND a.cycle_index = b.cycle_index AND a.step = b.step + 1
                    GROUP BY 1, 2)
        SELECT split, avg(abs(y - yhat) * CASE WHEN coalesce(masep, 0) = 0 THEN 0 ELSE mask / masep END) AS mase_loss
        FROM fc LEFT JOIN sc USING (battery_id, cycle_index) GROUP BY 1"""),
    "metrics_batched": q(["fc"], f"""
        SELECT b.*, a.smape_all, a.mse_all FROM (
        SELECT split, avg(smape_loss) AS smape_loss, avg(mse) AS mse, avg(mae) AS mae, avg(rmse) AS rmse,
               avg(mape) AS mape, avg(mspe) AS mspe, count(*) AS n_batches
        FROM (SELECT split, batch_id, {SMAPE} AS smape_loss, {MASKB} FROM fc GROUP BY 1, 2) GROUP BY 1) b
        JOIN (SELECT split, {SMAPE} AS smape_all, sum((yhat - y) * (yhat - y) * mask) / sum(mask) AS mse_all FROM fc GROUP BY 1) a USING (split)"""),
    "eval_last": q(["m4_train", "m4_test"], f"""
        WITH n AS (SELECT id, count(*) AS n FROM m4_train GROUP BY 1),
             w AS (SELECT t.id, t.pos - greatest(n.n - {Q.LAST_L}, 0) + ({Q.LAST_L} - least(n.n, {Q.LAST_L})) AS step, t.value
                   FROM m4_train t JOIN n USING (id) WHERE t.pos >= greatest(n.n - {Q.LAST_L}, 0)
                   UNION ALL
                   SELECT id, step, CAST(0 AS DOUBLE) FROM (SELECT id, unnest(range({Q.LAST_L} - least(n, {Q.LAST_L}))) AS step FROM n)),
             m AS (SELECT id, list_reduce(list(value ORDER BY step), lambda a, b: a + b) / count(*) AS yhat FROM w GROUP BY 1)
        SELECT 200 * avg(CASE WHEN abs(yhat) + abs(y) = 0 THEN 0 ELSE abs(yhat - y) / (abs(yhat) + abs(y)) END * 1.0) AS smape_loss
        FROM m4_test JOIN m USING (id)"""),
    "accuracy": None,  # filled below (shares point_adjust)
    "m4_group_scores": q(["m4_scores_model"], "SELECT * FROM m4_scores_model"),
    "mase": q(["m4_model", "m4_test", "m4_masep"], """
        SELECT id, CASE WHEN masep = 0 THEN NULL ELSE mae / masep END AS mase
        FROM (SELECT id, avg(abs(yhat - y)) AS mae FROM m4_test JOIN m4_model USING (id, step) GROUP BY 1)
        LEFT JOIN m4_masep USING (id)"""),
    "m4_summary": q(["m4_rg_model"], "SELECT * FROM m4_rg_model"),
    "m4_owa": q(["m4_rg_model", "m4_rg_base"], """
        SELECT grp, round_even(m.smape, 3) AS smape, round_even(m.mape, 3) AS mape, round_even(m.mase, 3) AS mase,
               round_even((m.mase / b.mase + m.smape / b.smape) / 2, 3) AS owa
        FROM m4_rg_model m JOIN m4_rg_base b USING (grp)"""),
    "result_table": q(["res"], "SELECT batch, seq, id, y, yhat FROM res"),
    "result_horizon": q(["res"], f"SELECT batch, seq, CAST(id - {U_SEQ} AS BIGINT) AS id, y, yhat FROM res WHERE id >= {U_SEQ}"),
    "result_dif": q(["res_dif"], "SELECT * FROM res_dif"),
    "result_nonzero": q(["res_dif"], "SELECT batch, seq, id, round_even(yhat, 3) AS yhat_r FROM res_dif WHERE dif <> 0"),
    "endpoint_error": q(["res_dif"], f"""
        WITH e AS (SELECT batch, seq, abs(dif) AS abs_dif FROM res_dif WHERE id = {SEQ_END})
        SELECT e.*, quantile_cont(abs_dif, 0.25) OVER () AS q25, quantile_cont(abs_dif, 0.75) OVER () AS q75 FROM e"""),
    "error_quantiles": q(["res_dif"], f"""
        SELECT quantile_cont(abs(dif), 0.25) AS q25, quantile_cont(abs(dif), 0.75) AS q75 FROM res_dif WHERE id = {SEQ_END}"""),
    "process_error": q(["res_dif"], f"""
        WITH m AS (SELECT batch, seq, avg(dif) AS mean_dif FROM res_dif WHERE id >= {U_SEQ} GROUP BY 1, 2)
        SELECT batch, seq, mean_dif, abs(mean_dif) AS abs_mean_dif,
               quantile_cont(mean_dif, 0.25) OVER () AS q25, quantile_cont(mean_dif, 0.75) OVER () AS q75 FROM m"""),
    "series_rmse": q(["res_dif"], f"SELECT batch, seq, sqrt(avg(dif * dif)) AS rmse FROM res_dif WHERE id >= {U_SEQ - 1} GROUP BY 1, 2"),
    "worst_series": q(["res_dif"], f"""
        SELECT batch, seq, sqrt(avg(dif * dif)) AS rmse FROM res_dif WHERE id >= {U_SEQ - 1} GROUP BY 1, 2
        ORDER BY rmse DESC, batch, seq LIMIT 10"""),
    "result_border": q(["res_masked"], f"""
        WITH b AS (SELECT batch, seq, coalesce(min(CASE WHEN mask = 0 AND id >= {M_SEQ} THEN id END), max(id) + 1) AS border FROM res_masked GROUP BY 1, 2)
        SELECT batch, seq, id, border, CASE WHEN mask = 0 THEN 1.95 ELSE y END AS y_plot, yhat
        FROM res_masked JOIN b USING (batch, seq) WHERE id >= {M_SEQ - 3} AND id < border + 2"""),
    "fc_mean": q(["mx"], f"""SELECT battery_id, cycle_index, CAST(h AS BIGINT) AS h, yhat
        FROM (SELECT battery_id, cycle_index, list_reduce(list(value ORDER BY step), lambda a, b: a + b) / count(*) AS yhat FROM mx GROUP BY 1, 2), (SELECT unnest(range({M_PRED})) AS h)"""),
    "eval_report": None,  # filled below
}

ORACLES["score_windows"] = ORACLES["fc_mean"]
ORACLES["fc_revin"] = q(["mx_stats"], f"""
    SELECT battery_id, cycle_index, CAST(h AS BIGINT) AS h, rv_mean + 0.5 * (rv_last - rv_mean) + rv_std AS yhat
    FROM mx_stats, (SELECT unnest(range({M_PRED})) AS h)""")
ORACLES["fc_drift"] = q(["mx"], f"""
    SELECT battery_id, cycle_index, CAST(h AS BIGINT) AS h, l + (l - f) / {M_SEQ - 1} * (h + 1) AS yhat
    FROM (SELECT battery_id, cycle_index, arg_max(value, step) AS l, arg_min(value, step) AS f FROM mx GROUP BY 1, 2), (SELECT unnest(range({M_PRED})) AS h)""")
# every customer is a series, also one of which no value is in the train part
cte("m4_cuts", ["m4_train"], """
  SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 4 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 5 ELSE 3 END AS horizon, count(t.id) AS n
  FROM customer LEFT JOIN m4_train t ON t.id = c_custkey GROUP BY ALL""")
_M4S, _M4H = f"({Q.M4_SEQ} * horizon)", "horizon"
cte("m4cuts", ["m4_cuts"], cuts_sql("m4_cuts", ["id"], "m4", _M4S, _M4H))
ORACLES["m4_windows"] = q(["m4_train", "m4cuts"], windows_sql("m4_train", "m4cuts", ["id"], "value", "m4", _M4S, _M4H, _M4H))
ORACLES["m4_rejects"] = q(["m4_cuts"], """
    SELECT id, n, low, n AS high FROM (SELECT *, greatest(1, n - CAST(floor(CAST(1.5 AS DOUBLE) * horizon) AS BIGINT)) AS low FROM m4_cuts) WHERE low >= n""")
ORACLES["last_windows"] = q(["m4_train", "m4_cuts"], f"""
    WITH n AS (SELECT id, n FROM m4_cuts)
    SELECT t.id, CAST(t.pos - greatest(n.n - {Q.LAST_L}, 0) + ({Q.LAST_L} - least(n.n, {Q.LAST_L})) AS BIGINT) AS step,
           t.value, CAST(1 AS DOUBLE) AS mask
    FROM m4_train t JOIN n USING (id) WHERE t.pos >= greatest(n.n - {Q.LAST_L}, 0)
    UNION ALL
    SELECT id, CAST(step AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
    FROM (SELECT id, unnest(range({Q.LAST_L} - least(n, {Q.LAST_L}))) AS step FROM n)""")
ORACLES["accuracy"] = q(["anom"], """
    WITH i AS (SELECT *, sum(CASE WHEN gt = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY pos
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM anom),
         hh AS (SELECT series_id, isl, max(CASE WHEN gt = 1 AND pred = 1 THEN 1 ELSE 0 END) AS hit FROM i GROUP BY 1, 2),
         a AS (SELECT gt, pred, CASE WHEN gt = 1 AND hit = 1 AND pos > 0 THEN 1 ELSE pred END AS pred_adj
               FROM i JOIN hh USING (series_id, isl))
    SELECT avg(CAST(gt = pred AS DOUBLE)) AS acc_raw, avg(CAST(gt = pred_adj AS DOUBLE)) AS acc_adj FROM a""")

_sc = ", ".join([f"avg({c}) AS mean_{c}" for c in CH]
                + [f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS std_{c}" for c in CH])
cte("er_rows", ["cycles", "sg"], "SELECT c.*, g.split FROM cycles c JOIN sg g USING (battery_id, cycle_index)")
cte("er_scaler", ["er_rows"], f"SELECT {_sc} FROM er_rows WHERE split = 'train'")
cte("er_scaled", ["er_rows", "er_scaler"], "SELECT battery_id, cycle_index, pos, " + ", ".join(
    f"({c} - mean_{c}) / std_{c} AS {c}" for c in CH) + " FROM er_rows, er_scaler")
cte("er_w", ["er_scaled", "cuts_cut"], windows_sql("er_scaled", "cuts_cut", KEYS, "target", "cut", *Q.UNMASKED))
ORACLES["eval_report"] = q(["er_w", "sg"], f"""
    WITH m AS (SELECT battery_id, cycle_index, avg(value) AS yhat FROM er_w WHERE part = 'x' GROUP BY 1, 2),
         d AS (SELECT g.split, floor(g.split_rank / {Q.BS}) AS batch_id, y.value AS y, m.yhat
               FROM er_w y JOIN m USING (battery_id, cycle_index) JOIN sg g USING (battery_id, cycle_index)
               WHERE y.part = 'y' AND y.step >= {U_LABEL}),
         b AS (SELECT split, batch_id, avg((yhat - y) * (yhat - y)) AS mse_loss, {EPSB} FROM d GROUP BY 1, 2)
    SELECT split, avg(mse_loss) AS mse_loss, avg(mse) AS mse, avg(mae) AS mae, avg(rmse) AS rmse, avg(mape) AS mape,
           avg(mspe) AS mspe, count(*) AS n_batches FROM b GROUP BY 1""")


_feats = ["cycle_index", *CH]
cte("cf_rows", ["cycles", "sg"], "SELECT c.pos, CAST(c.cycle_index AS DOUBLE) AS cycle_index, "
    + ", ".join(f"c.{c}" for c in CH) + ", g.split FROM cycles c JOIN sg g USING (battery_id, cycle_index)")
ORACLES["cycle_features"] = q(["cf_rows"], f"""
    WITH s AS (SELECT {", ".join([f"avg({c}) AS m_{c}" for c in _feats]
                                 + [f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in _feats])}
               FROM cf_rows WHERE split = 'train')
    SELECT split, pos, {", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in _feats)} FROM cf_rows, s""")
ORACLES["result_roundtrip"] = ORACLES["result_table"]
ORACLES["fc_linear_1"] = q(["w_cut", "sg"], f"""
    WITH x AS (SELECT battery_id, cycle_index, value AS x FROM w_cut WHERE part = 'x' AND step = {U_SEQ - 1}),
         y AS (SELECT battery_id, cycle_index, value AS y FROM w_cut WHERE part = 'y' AND step = {U_LABEL})
    SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
    FROM x JOIN y USING (battery_id, cycle_index) JOIN sg USING (battery_id, cycle_index) WHERE split = 'train'""")
# two-input least squares by Cramer's rule on centred moments
ORACLES["fc_linear"] = q(["w_cut", "sg"], f"""
    WITH a AS (SELECT battery_id, cycle_index, value AS a FROM w_cut WHERE part = 'x' AND step = {U_SEQ - 2}),
         b AS (SELECT battery_id, cycle_index, value AS b FROM w_cut WHERE part = 'x' AND step = {U_SEQ - 1}),
         y AS (SELECT battery_id, cycle_index, step - {U_LABEL} AS h, value AS y FROM w_cut WHERE part = 'y' AND step >= {U_LABEL} AND step < {U_LABEL + 3}),
         d AS (SELECT * FROM a JOIN b USING (battery_id, cycle_index) JOIN y USING (battery_id, cycle_index)
               JOIN (SELECT battery_id, cycle_index, split FROM sg) g USING (battery_id, cycle_index)),
         m AS (SELECT h, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy,
                      avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM d WHERE split = 'train' GROUP BY 1),
         c AS (SELECT h, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb, ma, mb, my FROM m)
    SELECT battery_id, cycle_index, CAST(h AS BIGINT) AS h, my + wa * (a - ma) + wb * (b - mb) AS yhat FROM d JOIN c USING (h) WHERE split = 'test'""")
ORACLES["fc_linear_channel"] = q(["melt"], f"""
    WITH p AS (SELECT x.channel, x.pos AS window_id, x.value AS x, y1.value AS y1, y2.value AS y2 FROM melt x
               JOIN melt y1 ON y1.channel = x.channel AND y1.pos = x.pos + 1 JOIN melt y2 ON y2.channel = x.channel AND y2.pos = x.pos + 2),
         t AS (SELECT * FROM p WHERE window_id < {Q.SCALER_LONG_TRAIN}),
         c AS (SELECT channel, coalesce(covar_pop(x, y1) / nullif(var_pop(x), 0), 0) AS s1, coalesce(covar_pop(x, y2) / nullif(var_pop(x), 0), 0) AS s2,
                      avg(x) AS mx, avg(y1) AS m1, avg(y2) AS m2 FROM t GROUP BY 1)
    SELECT channel, window_id, CAST(0 AS BIGINT) AS h, m1 + s1 * (x - mx) AS yhat FROM p JOIN c USING (channel)
    UNION ALL SELECT channel, window_id, CAST(1 AS BIGINT), m2 + s2 * (x - mx) FROM p JOIN c USING (channel)""")
ORACLES["score_marks"] = q(["daily"], f"""
    WITH s AS (SELECT pos AS s FROM daily WHERE pos + {Q.MARKS[0] + Q.MARKS[2]} <= (SELECT count(*) FROM daily))
    SELECT s.s AS window_id, CAST(h AS BIGINT) AS h, l.ot + 100 * (isodow(f.date) - 1) + 0.5 * d.ot AS yhat
    FROM s, (SELECT unnest(range({Q.MARKS[2]})) AS h) JOIN daily l ON l.pos = s.s + {Q.MARKS[0] - 1}
    JOIN daily d ON d.pos = s.s + {Q.MARKS[0] - Q.MARKS[1]} JOIN daily f ON f.pos = s.s + {Q.MARKS[0]} + h""")
cte("mxm", ["w_masked"], "SELECT battery_id, cycle_index, step, mask FROM w_masked WHERE part = 'x'")
ORACLES["patch_masks"] = q(["mxm"], f"""
    WITH p AS (SELECT battery_id, cycle_index, patch_id, j, patch_id * {Q.PATCH[1]} + j AS slot
               FROM (SELECT DISTINCT battery_id, cycle_index FROM mxm),
                    (SELECT unnest(range({(M_SEQ + Q.PATCH[1] - Q.PATCH[0]) // Q.PATCH[1] + 1})) AS patch_id), (SELECT unnest(range({Q.PATCH[0]})) AS j))
    SELECT p.battery_id, p.cycle_index, CAST(patch_id AS BIGINT) AS patch_id, CAST(j AS BIGINT) AS j, mask
    FROM p JOIN mxm m ON m.battery_id = p.battery_id AND m.cycle_index = p.cycle_index AND m.step = least(p.slot, {M_SEQ - 1})""")
ORACLES["period_agg_batch"] = q(["ev_ac", "evw_norm"], f"""
    WITH b AS (SELECT series_id, window_id, CAST(floor((row_number() OVER (ORDER BY {h('batch', ['series_id', 'window_id'])}, series_id, window_id) - 1) / {Q.BS}) AS BIGINT) AS batch_id
               FROM (SELECT DISTINCT series_id, window_id FROM ev_ac)),
         rb AS (SELECT b.batch_id, a.lag, avg(a.r) AS rb FROM ev_ac a JOIN b USING (series_id, window_id) GROUP BY 1, 2),
         tl AS (SELECT batch_id, lag FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY round(-rb, 9), lag) AS k FROM rb)
                WHERE k <= {max(1, int(math.log(EV_L)))}),
         t AS (SELECT a.series_id, a.window_id, a.lag, a.r FROM ev_ac a JOIN b USING (series_id, window_id) JOIN tl ON tl.batch_id = b.batch_id AND tl.lag = a.lag),
         e AS (SELECT series_id, window_id, lag, exp(r - max(r) OVER (PARTITION BY series_id, window_id)) AS ex FROM t),
         wt AS (SELECT series_id, window_id, lag, ex / sum(ex) OVER (PARTITION BY series_id, window_id) AS w FROM e)
    SELECT x.series_id, x.window_id, CAST(x.step AS BIGINT) AS t, sum(wt.w * v.value) AS value
    FROM evw_norm x JOIN wt USING (series_id, window_id)
    JOIN evw_norm v ON v.series_id = x.series_id AND v.window_id = x.window_id AND v.step = (x.step + wt.lag) % {EV_L}
    GROUP BY 1, 2, 3""")
cte("hw", ["melt"], f"""
  SELECT s.channel, s.pos AS window_id, list(b.value ORDER BY b.pos) AS x
  FROM melt s JOIN melt b ON b.channel = s.channel AND b.pos >= s.pos AND b.pos < s.pos + {EV_L} GROUP BY 1, 2 HAVING count(*) = {EV_L}""")
cte("hw_ac", ["hw"], autocorr_sql("hw", "channel, window_id, x", EV_L))
ORACLES["period_agg_full"] = q(["hw_ac"], f"""
    WITH t AS (SELECT *, row_number() OVER (PARTITION BY channel, window_id ORDER BY round(-r, 9), lag) AS k FROM hw_ac),
         e AS (SELECT *, exp(r - max(r) OVER (PARTITION BY channel, window_id)) AS ex FROM t WHERE k <= {max(1, int(0.7 * math.log(EV_L)))}),
         wt AS (SELECT *, ex / sum(ex) OVER (PARTITION BY channel, window_id) AS w FROM e)
    SELECT channel, window_id, CAST(t AS BIGINT) AS t, sum(w * x[(t + lag) % {EV_L} + 1]) AS value
    FROM wt, (SELECT unnest(range({EV_L})) AS t) GROUP BY 1, 2, 3""")
_second, _minute = "second(ts) / CAST(59 AS DOUBLE) - 0.5", "minute(ts) / CAST(59 AS DOUBLE) - 0.5"
_hour, _wday = "hour(ts) / CAST(23 AS DOUBLE) - 0.5", "(isodow(ts) - 1) / CAST(6 AS DOUBLE) - 0.5"
_mday, _yday = "(day(ts) - 1) / CAST(30 AS DOUBLE) - 0.5", "(dayofyear(ts) - 1) / CAST(365 AS DOUBLE) - 0.5"
_month, _week = "(month(ts) - 1) / CAST(11 AS DOUBLE) - 0.5", "(weekofyear(ts) - 1) / CAST(52 AS DOUBLE) - 0.5"
ORACLES["time_features_all"] = q(["ev"], " UNION ALL ".join(
    f"SELECT series_id, pos, '{f}' AS freq, {i} AS slot, {e} AS value FROM ev" for f, es in {
        "Q": [_month], "M": [_month], "W-SUN": [_mday, _week], "B": [_wday, _mday, _yday], "H": [_hour, _wday, _mday, _yday],
        "S": [_second, _minute, _hour, _wday, _mday, _yday]}.items() for i, e in enumerate(es)))

ORACLES["scaler_long"] = q(["melt"], f"""
    WITH s AS (SELECT channel, avg(value) AS m, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS sd
               FROM melt WHERE pos < {Q.SCALER_LONG_TRAIN} GROUP BY 1)
    SELECT pos, channel, (value - m) / sd AS value FROM melt JOIN s USING (channel)""")
ORACLES["time_features_daily"] = q(["daily"], """
    SELECT pos, (isodow(date) - 1) / CAST(6 AS DOUBLE) - 0.5 AS day_of_week,
           (day(date) - 1) / CAST(30 AS DOUBLE) - 0.5 AS day_of_month,
           (dayofyear(date) - 1) / CAST(365 AS DOUBLE) - 0.5 AS day_of_year FROM daily""")
ORACLES["feature_mode_s"] = q(["daily"], "SELECT CAST(date AS VARCHAR) AS date, pos, ot FROM daily")
ORACLES["shortest_cycle"] = q(["clen"], """
    SELECT battery_id, cycle_index, n FROM clen ORDER BY n, battery_id DESC, cycle_index DESC LIMIT 1""")

_KEY = "|| CAST(epoch AS VARCHAR) || '|' || CAST(i AS VARCHAR) || '|'"
_OTHER = f"(((CAST('0x' || substr(md5('epoch|{Q.SEED}|' {_KEY} || 'key'), 1, 12) AS BIGINT) - a) % c + c) % c)"
ORACLES["batches_epoch"] = q(["sg"], f"""
    WITH e AS (SELECT sg.*, count(*) OVER (PARTITION BY split) AS c FROM sg),
         s AS (SELECT battery_id, cycle_index, split, epoch, CASE WHEN split = 'test' THEN split_rank ELSE list_reduce(list_prepend(CAST(split_rank AS BIGINT), range(32)),
                   lambda a, i: CASE WHEN substr(md5('epoch|{Q.SEED}|' {_KEY} || CAST(greatest(a, {_OTHER}) AS VARCHAR)), 1, 1) >= '8' THEN {_OTHER} ELSE a END) END AS r
               FROM e, (SELECT CAST(unnest(range({Q.EPOCHS})) AS BIGINT) AS epoch))
    SELECT battery_id, cycle_index, split, epoch, CAST(floor(r / {Q.BS}) AS BIGINT) AS batch_id, CAST(r % {Q.BS} AS BIGINT) AS batch_seq FROM s""")
ORACLES["scan_accepted"] = """
    SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0"""
ORACLES["scan_rejects"] = """
    SELECT o_orderkey || 'x,' || o_custkey || ',' || o_orderpriority AS line, 'o_orderkey' AS reason FROM orders WHERE o_orderkey % 17 = 0
    UNION ALL SELECT o_orderkey || ',' || o_custkey, 'fields' FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 23 = 0
    UNION ALL SELECT o_orderkey || ',' || o_custkey || ',' || o_orderpriority || ',more', 'fields' FROM orders
    WHERE o_orderkey % 17 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 = 0"""
ORACLES["prompt_bank"] = """
    WITH c AS (SELECT c_custkey, c_mktsegment AS seg, CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN 'ETT' ELSE c_mktsegment END AS family FROM customer),
         b AS (SELECT family, 'The data set has ' || count(*) || ' series.' || chr(10) || 'The last is ' || max(c_custkey) || '.' AS content FROM c WHERE seg <> 'HOUSEHOLD' GROUP BY 1)
    SELECT c_custkey, CASE seg WHEN 'FURNITURE' THEN 'ETTh1' WHEN 'MACHINERY' THEN 'ETTm2' ELSE seg END AS data, content FROM c LEFT JOIN b USING (family)"""
