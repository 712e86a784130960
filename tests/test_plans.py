"""What the plans must and must not contain."""

import pytest

from tierworks.plans.commerce import Commerce, StoredGold
from tierworks.plans.registry import QUERIES

# These write tables or train models when they are built; their plans only read the result.
EAGER = {
    "raw_scan", "layer_round_trip", "append_union", "stream_append", "format_round_trip", "format_contents", "features_sink", "run_layer_report",
    "scenario_parity", "timed_workloads", "ml_preflight", "risk_scores", "class_metrics", "confusion_matrix", "v_risk",
    "v_opportunity", "opportunity_scores", "cluster_quality", "risk_features", "risk_coverage", "rule_metrics", "rule_confusion",
}
# The only unpartitioned window runs over the histogram of key counts.
ONE_PARTITION_WINDOW = {"key_skew", "silver_run_summary"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_products_and_no_python(spark, sf, name, no_broadcast):
    text = plan(QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas"):
        assert bad not in text
    if name not in ONE_PARTITION_WINDOW:
        windows = [line for line in text.splitlines() if "Window [" in line or "+- Window" in line]
        # Every window names its partition columns: the list after the expressions is not empty.
        assert not [w for w in windows if w.rstrip().split("windowspecdefinition")[-1].startswith("(ORDER")]


def scans(df):
    return [line for line in plan(df).splitlines() if "FileScan parquet" in line]


def test_columns_and_filters_reach_the_scan(spark, sf):
    c = Commerce(spark, sf)
    [scan] = scans(QUERIES["w2_group_agg"](spark, sf))
    assert "ReadSchema: struct<c_nationkey:int,c_acctbal:double>" in scan
    filtered = [s for s in scans(QUERIES["w3_filter_join"](spark, sf)) if "c_custkey" in s]
    assert "GreaterThanOrEqual(c_acctbal,5000.0)" in filtered[0]
    open_orders = [s for s in scans(c.fact_kpi6()) if "o_orderstatus" in s]
    assert "EqualTo(o_orderstatus,O)" in open_orders[0] and "EqualTo(o_orderpriority,1-URGENT)" in open_orders[0]
    assert all("o_totalprice" not in s for s in open_orders)


def test_counting_reads_no_column(spark, sf):
    assert all("ReadSchema: struct<>" in s for s in scans(QUERIES["entity_census"](spark, sf)))
    assert all("ReadSchema: struct<>" in s for s in scans(QUERIES["table_row_counts"](spark, sf)))


def test_small_references_are_broadcast_and_large_ones_are_not(spark, sf):
    c = Commerce(spark, sf)
    assert "BroadcastHashJoin" in plan(c.fact_kpi1())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(c.fact_kpi1())
        # Orders are summed per customer before the join.
        assert "SortMergeJoin" in text and text.count("partial_sum") == 2 * text.count("SortMergeJoin") * 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")



SERVING = ["v_recap_year", "v_kpi_by_org_year", "pivot_year_kpi", "w4_fact_dim_join", "w5_recap_by_year", "w6_recap_status", "flagship", "forecast_drift"]


@pytest.mark.parametrize("name", SERVING)
def test_serving_reads_stored_gold(spark, sf, name):
    """No serving query scans a raw table, and none writes when gold is there already."""
    QUERIES[name](spark, sf)
    before = dict(StoredGold.WRITTEN)
    found = scans(QUERIES[name](spark, sf))
    assert found and StoredGold.WRITTEN == before
    assert not [line for line in found if f"{sf}/" in line]
