"""Plan-level scale checks over every registered query (the reference's test strategy, item 4):
no window function runs over a whole table in one task unless it is the bounded bucket
table of a bucketed rank, and no Python row-at-a-time UDF appears in any plan."""

import re

import pytest

import __spark_entry__ as E
from tsflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _groups(text: str) -> list[str]:
    """Top-level [...] groups of a plan line."""
    out, depth, cur = [], 0, []
    for ch in text:
        if ch == "[":
            depth += 1
            if depth == 1:
                cur = []
                continue
        elif ch == "]":
            depth -= 1
            if depth == 0:
                out.append("".join(cur))
                continue
        if depth >= 1:
            cur.append(ch)
    return out


def _unpartitioned_windows(plan: str) -> list[str]:
    """Window operators without partition keys.  Spark prints ``Window [exprs], [partition],
    [order]`` and drops an empty list, so two groups whose second is a sort order mean no
    partition keys."""
    bad = []
    for line in plan.splitlines():
        i = line.find("Window [")
        if i < 0:
            continue
        g = _groups(line[i + len("Window "):])
        if len(g) == 2 and re.search(r"\b(ASC|DESC)\b", g[1]):
            bad.append(line.strip())
        elif len(g) >= 3 and g[1].strip() == "":
            bad.append(line.strip())
    return bad


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_whole_table_window(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    for line in _unpartitioned_windows(plan):
        assert "_bkt" in line, f"{name}: one-task window over data: {line[:200]}"
    assert "BatchEvalPython" not in plan, f"{name}: row-at-a-time Python UDF in plan"


def test_bucketed_position_has_no_global_window(spark):
    from pyspark.sql import functions as F
    from tsflow.operators.order import with_position
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("t"))
    plan = _plan(with_position(df, ["k"], ["t"], bucket=F.floor(F.col("t") / 10)))
    assert "hashpartitioning(k" in plan and "_bkt" in plan
    assert not _unpartitioned_windows(plan)


def test_detector_flags_a_global_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = spark.range(100).withColumn("rn", F.row_number().over(Window.orderBy("id")))
    assert _unpartitioned_windows(_plan(df))


@pytest.mark.parametrize("name", ["cycles", "ev", "hourly", "daily", "m4c", "anom"])
def test_fixture_plans_have_no_whole_table_window(spark, name):
    from tsflow.sources import fixtures as fx
    plan = _plan(getattr(fx, name)(spark, SF))
    for line in _unpartitioned_windows(plan):
        assert "_bkt" in line, f"{name}: one-task window over data: {line[:200]}"


def test_group_split_plan(spark):
    from tsflow.operators.splits import split_groups
    from tsflow.operators.windows import series_lengths
    from tsflow.sources import fixtures as fx
    lens = series_lengths(fx.cycles(spark, SF), fx.CYCLE_KEYS)
    plan = _plan(split_groups(lens, fx.CYCLE_KEYS))
    for line in _unpartitioned_windows(plan):
        assert "_bkt" in line, line[:200]
