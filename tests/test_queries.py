"""Registered queries against their SQL, in both layouts, and plan checks."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from tidalspan.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
# Queries that together cover every layout helper, also run with tests cut into chunks.
SPLIT = ["a7_find_peaks", "w3_outlier_scores", "w4_intensity_runs", "w7_v_slope", "w9_end_plateau", "w12_stages_ramp",
         "w13_stages_phase", "j4_asof_stage", "a6_display_stages", "a8_power_increment", "s7_data_type", "c5_protocol_config"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


@pytest.mark.parametrize("name", SPLIT)
def test_matches_sql_when_tests_are_split(spark, con, name):
    spark.conf.set("spark.tidalspan.chunkRows", "20")
    try:
        assert compare(spark, con, FOLDER, name) is None
    finally:
        spark.conf.unset("spark.tidalspan.chunkRows")


def test_entry(spark):
    assert entry(spark).count() == 15


@pytest.mark.parametrize("name, limit", [("a7_find_peaks", 1), ("w1_average_rolling", 1), ("w7_v_slope", 1), ("a1_average_by_time", 2)])
def test_one_exchange_on_the_test(spark, name, limit):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("BroadcastExchange hashpartitioning") <= limit
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
