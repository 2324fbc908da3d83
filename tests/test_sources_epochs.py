"""Epoch orders, scans with rejects, prompt banks and series without train values."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsflow.functions.core import permuted
from tsflow.operators.splits import with_batches, with_epochs
from tsflow.plans.compare import compare, duck
from tsflow.plans.oracles import ORACLES
from tsflow.plans.queries import QUERIES
from tsflow.sources import readers

SF0001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000, 4099])
def test_each_epoch_is_a_permutation(spark, n):
    df = spark.range(n).withColumns({"n": F.lit(n).cast("long")})
    rows = with_epochs(df, "id", "n", 3).collect()
    orders = [[r.id for r in rows if r.epoch == e] for e in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    if n > 60:
        assert len({tuple(o) for o in orders}) == 3
        same = sum(a == b for a, b in zip(orders[0], orders[1]))
        neighbours = sum(abs(a - b) == 1 for a, b in zip(orders[0], orders[0][1:]))
        assert same < 12 and neighbours < 15


def test_epochs_leave_other_splits_alone_and_need_no_shuffle(spark):
    df = spark.createDataFrame([(k, s, k, 50) for s in ("train", "test") for k in range(50)], "key long, split string, rank long, n long")
    out = with_batches(with_epochs(df, "rank", "n", 2, shuffled=F.col("split") != "test"), "rank", 8)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert all(r["rank"] == r.key for r in rows if r.split == "test")
    assert any(r["rank"] != r.key for r in rows if r.split == "train")
    assert {r.batch_id for r in rows} == set(range(7))


def test_permutation_of_nulls_is_null(spark):
    df = spark.createDataFrame([(None, 5), (1, None)], "x long, n long")
    assert [r[0] for r in df.select(permuted(F.col("x"), F.col("n"), "t", 1, F.lit(0))).collect()] == [None, None]


def test_rejected_lines_are_kept_whole(spark, tmp_path):
    good = ["2020-01-01 00:00:00,1,1.5,a", "2020-01-02 00:00:00,,-2,\"b,c\"", "2020-01-03 00:00:00,3,,", "2020-01-04 00:00:00,4,NaN,\"say \"\"x\"\"\""]
    bad = {"not a date,1,1.5,a": "t", "2020-01-01 00:00:00,1.x,1,a": "k", "2020-01-01 00:00:00,1,one,a": "v",
           "2020-01-01 00:00:00,1,1": "fields", "2020-01-01 00:00:00,1,1,a,": "fields", "alone": "fields"}
    (tmp_path / "a.csv").write_text("\n".join(["t,k,v,s", *good, "", *bad]) + "\n")
    schema = T.StructType.fromDDL("t timestamp, k bigint, v double, s string")
    kept, rejected = readers.read_rejecting(spark, str(tmp_path), schema)
    assert kept.schema.simpleString() == schema.simpleString()
    rows = sorted(kept.collect(), key=lambda r: r.t)
    assert [(r.k, r.s) for r in rows] == [(1, "a"), (None, "b,c"), (3, None), (4, 'say "x"')]
    assert [r.v for r in rows][:3] == [1.5, -2.0, None]
    assert {r.line: r.reason for r in rejected.collect()} == bad
    assert kept.select("k").count() == 4 and rejected.select("reason").count() == len(bad)  # pruning changes neither


def test_prompt_bank_forms_agree(spark, tmp_path):
    bank = spark.createDataFrame([("ETT", "two\nlines"), ("007", "number"), ("a b", "")], "name string, content string")
    readers.write_prompt_bank(bank, str(tmp_path / "written"))
    (tmp_path / "plain").mkdir()
    for r in bank.collect():
        (tmp_path / "plain" / f"{r.name}.txt").write_text(r.content)
    written = readers.read_prompt_bank(spark, str(tmp_path / "written"), partitioned=True)
    assert dict(written.collect()) == dict(bank.collect())
    wanted = spark.createDataFrame([("ETTh1",), ("ETTm2",), ("007",), ("none",)], "data string")
    found = dict(readers.with_content(wanted, written, "data").collect())
    assert found == {"ETTh1": "two\nlines", "ETTm2": "two\nlines", "007": "number", "none": None}
    plain = readers.with_content(wanted.where("data != '007'"), readers.read_prompt_bank(spark, str(tmp_path / "plain")), "data")
    assert dict(plain.collect()) == {"ETTh1": "two\nlines", "ETTm2": "two\nlines", "none": None}


def test_every_series_has_a_window_or_is_listed(spark):
    ids = {r.c_custkey for r in spark.read.parquet(f"{SF0001}/customer.parquet").collect()}
    windows = {r.id for r in QUERIES["m4_windows"](spark, SF0001).select("id").distinct().collect()}
    rejects = {r.id for r in QUERIES["m4_rejects"](spark, SF0001).collect()}
    assert windows | rejects == ids and not windows & rejects
    last = QUERIES["last_windows"](spark, SF0001).groupBy("id").count().collect()
    assert {r.id for r in last} == ids and len({r["count"] for r in last}) == 1


@pytest.mark.parametrize("name", ["batches_epoch", "scan_accepted", "scan_rejects", "prompt_bank", "m4_rejects", "last_windows"])
def test_queries_match_sql(spark, name):
    ok, message = compare(QUERIES[name](spark, SF0001), duck(SF0001), ORACLES[name])
    assert ok, message
