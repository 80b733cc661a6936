"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from tidegrid.catalogue import ORACLES, QUERIES
from tidegrid.sources import tables

# One or more of every kind; the others share their operators.
CHECKED = ("s4 s6 k1 k3 k6 k9 p13 p16 o1 o2 o3 u1 t6 d14 d15 j1 j2 j3 j4 j5 j6 j7 j8 j9 a1 a2 a3 a4 a5 a6 a9 w1 w2 w3 w4 "
           "w5 w6 w7 w9 m20 m21 p5 f1 f2 f6 f7 f9 f10 f11 f12 f14 f17 f18 b2 b3 b4 b5 e4 e5 g1 g2 g3 g4 g5 g7 "
           "backtest_rolling_window backtest_smoothing_layer").split()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] in CHECKED or n in CHECKED])
def test_no_cross_join_and_no_single_task(spark, small, name):
    plan = plan_of(QUERIES[name](spark, small))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A single task may only hold a grand total (one row per map task).
    singles = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(singles) <= plan.count("functions=[partial") or not singles
    assert not re.search(r"Window .*windowspecdefinition\(ts#", plan), "window over a whole table"


def test_filter_and_columns_reach_the_scan(spark, small):
    plan = plan_of(QUERIES["p15_range_slice"](spark, small))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_scans_read_only_used_columns(spark, small):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(tables.hourly_events(spark, small)))
    assert schemas == ["ts:timestamp_ntz,event_type:string,value:double"]


def test_means_are_formed_before_the_shuffle(spark, small):
    plan = plan_of(tables.hourly_events(spark, small))
    assert plan.index("partial_avg") > plan.index("Exchange hashpartitioning")


def test_lags_share_one_shuffle(spark, small):
    plan = plan_of(QUERIES["w1_zero_lag"](spark, small))
    assert len(re.findall(r"Window \[lag\(", plan)) == 1
    assert re.search(r"hashpartitioning\(series_id#\d+, _block#\d+L", plan)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) > 140
