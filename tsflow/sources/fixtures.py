"""Time-series inputs derived from the driver tables (see FIXTURES.md).

Each builder reads the driver parquet (declared schema, pruned columns) and
returns a lazy DataFrame.  Positions come from ``with_position`` / ``global_rank``
(bucketed by day or year), so no series or table is numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsflow.operators.order import global_rank, with_group_count, with_position
from tsflow.sources.readers import read_table

# The event types and order priorities that become channels of their own.  Rows of
# any other type or priority (or none) go to the channel ``other`` / ``px``, so no row is lost.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = [("p1", "1-URGENT"), ("p2", "2-HIGH"), ("p3", "3-MEDIUM"), ("p4", "4-NOT SPECIFIED"), ("ot", "5-LOW")]
CYCLE_KEYS = ["battery_id", "cycle_index"]
CYCLE_CHANNELS = ["cycle_test_time", "c_qty", "c_disc", "c_tax", "target"]
HOURLY_CHANNELS = [f"{k}_{t}" for k in "nv" for t in [*EVENT_TYPES, "other"]]
DAILY_CHANNELS = ["px", *(c for c, _ in PRIORITIES)]


def _day(ts) -> F.Column:
    return F.unix_date(F.to_date(ts))


def cycle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the sensor cycles without positions (enough for their lengths)."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("battery_id"), F.year("l_shipdate").cast("int").alias("cycle_index"),
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_quantity").alias("c_qty"), F.col("l_discount").alias("c_disc"), F.col("l_tax").alias("c_tax"),
        (F.col("l_extendedprice") / 1000).alias("target"))


def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor cycles: battery = supplier, cycle = ship year, ordered by ship date (buckets: quarters)."""
    d = with_position(cycle_rows(spark, sf_dir), CYCLE_KEYS, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"],
                      bucket=F.quarter("l_shipdate"), first=("_d0", _day("l_shipdate")))
    return d.select(*CYCLE_KEYS, "pos", (_day("l_shipdate") - F.col("_d0")).cast("double").alias("cycle_test_time"),
                    "c_qty", "c_disc", "c_tax", "target")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short univariate series: one per user, ordered by (ts, event_id)."""
    e = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series_id"), "ts", "event_id", "value", "event_type")
    d = with_position(e, ["series_id"], ["ts", "event_id"], bucket=F.floor(_day("ts") / 14))
    return d.select("series_id", "pos", "ts", "value", "event_type")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long multi-channel series: per hour, count and value sum per event type (zero-filled)."""
    e = read_table(spark, sf_dir, "events").select("ts", "event_type", "value")
    h = F.date_trunc("hour", "ts")
    of = {t: F.col("event_type") == t for t in EVENT_TYPES}
    of["other"] = ~F.coalesce(F.col("event_type").isin(EVENT_TYPES), F.lit(False))
    aggs = [F.count(F.when(c, 1)).cast("double").alias(f"n_{t}") for t, c in of.items()]
    aggs += [F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0.0)).alias(f"v_{t}") for t, c in of.items()]
    g = e.groupBy(h.alias("hour_ts")).agg(*aggs)
    g = global_rank(g, ["hour_ts"], bucket=_day("hour_ts"), name="pos")
    return g.select("hour_ts", "pos", *HOURLY_CHANNELS)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide time table: order date x 5 priorities, summed total price, missing pairs 0."""
    o = read_table(spark, sf_dir, "orders").select("o_orderdate", "o_orderpriority", "o_totalprice")
    of = {c: F.col("o_orderpriority") == p for c, p in PRIORITIES}
    of["px"] = ~F.coalesce(F.col("o_orderpriority").isin([p for _, p in PRIORITIES]), F.lit(False))
    aggs = [F.coalesce(F.sum(F.when(x, F.col("o_totalprice"))), F.lit(0.0)).alias(c) for c, x in of.items()]
    g = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(*aggs)
    g = global_rank(g, ["date"], bucket=F.year("date"), name="pos")
    return g.select("date", "pos", *DAILY_CHANNELS)


# M4-style layout of the customer-order series: (frequency, horizon) of each group.
M4_MAIN_GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
M4_GROUPS = {"AUTOMOBILE": (1, 3), "BUILDING": (4, 4), "FURNITURE": (2, 2), "HOUSEHOLD": (1, 3), "MACHINERY": (3, 5)}
M4_OTHER = (1, 3)
M4_FREQS = sorted({f for f, _ in [*M4_GROUPS.values(), M4_OTHER]})


def m4_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Info table: every customer's group with its frequency and horizon."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("grp"))

    def of(k: int):
        e = F.lit(M4_OTHER[k])
        for g, v in M4_GROUPS.items():
            e = F.when(F.col("grp") == g, F.lit(v[k])).otherwise(e)
        return e
    return c.select("id", "grp", of(0).alias("freq"), of(1).alias("horizon"))


def m4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged values: each customer's orders by (date, key), every length, with a NaN tail slot."""
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderdate", "o_orderkey",
                                                   F.col("o_totalprice").alias("value"))
    d = with_position(o, ["id"], ["o_orderdate", "o_orderkey"], bucket=F.year("o_orderdate")).select("id", "pos", "value")
    tail = o.groupBy("id").agg(F.count(F.lit(1)).alias("pos")).select("id", "pos", F.lit(float("nan")).alias("value"))
    return d.unionByName(tail)


def m4c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Info joined to the values without their NaN tails; the last ``horizon`` values are the test part."""
    from tsflow.operators.m4 import m4_series
    d = with_group_count(m4_series(m4_info(spark, sf_dir), m4_values(spark, sf_dir)), ["id"], name="n")
    part = F.when(F.col("pos") < F.col("n") - F.col("horizon"), F.lit("train")).otherwise(F.lit("test"))
    return d.select("id", "grp", "freq", "horizon", "pos", "value", "n", part.alias("part"))


def anom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly flags per ``ev`` series: gt = error event or value > 100, pred = value > 120."""
    e = ev(spark, sf_dir)
    return e.select("series_id", "pos",
                    ((F.col("event_type") == "error") | (F.col("value") > 100)).cast("int").alias("gt"),
                    (F.col("value") > 120).cast("int").alias("pred"))
