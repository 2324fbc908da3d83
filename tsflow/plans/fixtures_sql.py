"""The fixtures of ``tsflow.sources.fixtures`` as DuckDB SQL (common table expressions).

Oracles are built from these so DuckDB and Spark start from the same rows.
DuckDB notes: ``::BIGINT`` rounds (Spark truncates) -> ``floor``; decimal literals
are cast to DOUBLE; the md5 prefix is read as ``('0x' || hex)::BIGINT``.
"""

from __future__ import annotations

SEED = 42

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


def h(tag: str, keys: list[str], digits: int = 8) -> str:
    parts = ", ".join([f"'{tag}'", f"'{SEED}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"('0x' || substr(md5(concat_ws('|', {parts})), 1, {digits}))::BIGINT"


def with_ctes(needed: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needed:
        visit(n)
    if not order:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return "WITH " + head + ",\n" + b[5:]
    return "WITH " + head + "\n" + body


cte("cycles", [], """
  SELECT l_suppkey AS battery_id, CAST(year(l_shipdate) AS INTEGER) AS cycle_index,
    CAST(row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate)
         ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS BIGINT) AS pos,
    CAST(date_diff('day', CAST(min(l_shipdate) OVER (PARTITION BY l_suppkey, year(l_shipdate)) AS DATE),
         CAST(l_shipdate AS DATE)) AS DOUBLE) AS cycle_test_time,
    l_quantity AS c_qty, l_discount AS c_disc, l_tax AS c_tax, l_extendedprice / 1000 AS target
  FROM lineitem""")

cte("ev", [], """
  SELECT user_id AS series_id,
    CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
    ts, value, event_type
  FROM events""")

_types = ["click", "error", "purchase", "signup", "view"]
_is = {t: f"event_type = '{t}'" for t in _types} | {
    "other": "event_type IS NULL OR event_type NOT IN (" + ", ".join(f"'{t}'" for t in _types) + ")"}
cte("hourly", [], """
  SELECT hour_ts, CAST(row_number() OVER (ORDER BY hour_ts) - 1 AS BIGINT) AS pos, {cols}
  FROM (SELECT date_trunc('hour', ts) AS hour_ts, {aggs} FROM events GROUP BY 1)""".format(
    cols=", ".join(f"{k}_{t}" for k in "nv" for t in _is),
    aggs=", ".join([f"CAST(count(*) FILTER (WHERE {c}) AS DOUBLE) AS n_{t}" for t, c in _is.items()]
                   + [f"coalesce(sum(value) FILTER (WHERE {c}), 0.0) AS v_{t}" for t, c in _is.items()])))

_prio = {"p1": "1-URGENT", "p2": "2-HIGH", "p3": "3-MEDIUM", "p4": "4-NOT SPECIFIED", "ot": "5-LOW"}
_has = {c: f"o_orderpriority = '{p}'" for c, p in _prio.items()} | {
    "px": "o_orderpriority IS NULL OR o_orderpriority NOT IN (" + ", ".join(f"'{p}'" for p in _prio.values()) + ")"}
cte("daily", [], """
  SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS BIGINT) AS pos, px, p1, p2, p3, p4, ot
  FROM (SELECT CAST(o_orderdate AS DATE) AS date, {aggs} FROM orders GROUP BY 1)""".format(
    aggs=", ".join(f"coalesce(sum(o_totalprice) FILTER (WHERE {x}), 0.0) AS {c}" for c, x in _has.items())))

cte("m4c", [], """
  SELECT id, grp, freq, horizon, pos, value, n, CASE WHEN pos < n - horizon THEN 'train' ELSE 'test' END AS part
  FROM (SELECT o_custkey AS id, c_mktsegment AS grp, o_totalprice AS value,
          CASE c_mktsegment WHEN 'BUILDING' THEN 4 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 1 END AS freq,
          CASE c_mktsegment WHEN 'BUILDING' THEN 4 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 5 ELSE 3 END AS horizon,
          CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS pos,
          count(*) OVER (PARTITION BY o_custkey) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey)""")

cte("anom", ["ev"], """
  SELECT series_id, pos, CAST(event_type = 'error' OR value > 100 AS INTEGER) AS gt,
         CAST(value > 120 AS INTEGER) AS pred
  FROM ev""")

# kept cycles (length > 60) and their group split
cte("clen", ["cycles"], """
  SELECT battery_id, cycle_index, count(cycle_test_time) AS n FROM cycles GROUP BY 1, 2""")
cte("kept", ["clen"], "SELECT * FROM clen WHERE n > 60")
cte("sg", ["kept"], f"""
  SELECT battery_id, cycle_index, n, split, rk AS rank,
    CAST(rk - CASE WHEN split = 'train' THEN 0 WHEN split = 'val' THEN b1 ELSE b2 END AS BIGINT) AS split_rank
  FROM (SELECT *, CASE WHEN rk < b1 THEN 'train' WHEN rk < b2 THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, floor(CAST(0.6 AS DOUBLE) * nk) AS b1, floor(CAST(0.7 AS DOUBLE) * nk) AS b2
              FROM (SELECT *, CAST(row_number() OVER (ORDER BY hh, battery_id, cycle_index) - 1 AS BIGINT) AS rk,
                           count(*) OVER () AS nk
                    FROM (SELECT *, {h('split', ['battery_id', 'cycle_index'])} AS hh FROM kept))))""")
