"""Registered queries against their DuckDB oracles (the driver's correctness gate).

Default: a representative subset at sf0.001; TSFLOW_FULL=1 runs every query at sf0.01.
"""

import os

import pytest

import __spark_entry__ as E
from tsflow.plans.compare import compare, duck

FULL = os.environ.get("TSFLOW_FULL") == "1"
SF = "/root/testdata/sf0.01" if FULL else "/root/testdata/sf0.001"
SUBSET = ["scan_cycles", "scan_wide", "m4_windows", "m4_load", "fc_linear", "fc_linear_channel", "fc_revin", "scaler_inverse", "cycle_features", "result_roundtrip", "fc_linear_1", "period_agg_batch", "split_groups", "masked_windows", "cut_windows", "sliding_windows", "time_features",
          "moving_avg", "prompt_text", "point_adjust", "metrics_masked", "m4_owa", "result_border", "eval_report"]
NAMES = sorted(set(E.oracle_sql()) - set(E._text_operators()[1])) if FULL else SUBSET


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle_or_is_documented():
    from tsflow.plans.queries import QUERIES
    missing = set(QUERIES) - set(E.oracle_sql())
    assert missing == {"fc_linear_full"}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["split", "mse_loss", "mse", "mae", "rmse", "mape", "mspe", "n_batches"]
    assert df.count() == 3
