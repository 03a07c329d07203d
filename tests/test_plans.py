"""Physical plans: how often rows shuffle, and what reaches the scan."""

import os
import re

import pytest

from evspark.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(spark, name):
    return registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "most"), [("window_identity_corr", 1), ("gap_anchors", 1), ("primary_evidence", 1), ("power_sessions", 1), ("session_bands", 1), ("hourly_heatmap", 1), ("rule_tags", 0), ("unpivot_timeline", 0), ("bucket_counts", 2), ("interval_clip", 1), ("weighted_score", 2)])
def test_shuffles(spark, name, most):
    assert len(re.findall(r"\bExchange\b", plan(spark, name))) <= most


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = plan(spark, "full_scan")
    assert "EqualTo(o_orderstatus,F)" in p and "EqualTo(o_orderpriority,1-URGENT)" in p
    assert set(re.search(r"ReadSchema: struct<([^>]*)>", p)[1].split(",")) == {"o_orderkey:bigint", "o_orderstatus:string", "o_totalprice:double", "o_orderpriority:string"}


@pytest.mark.parametrize("name", ["band_join_pairs", "correlated_pairs", "interval_overlap", "all_anchor_pairs", "field_lookup", "path_similarity"])
def test_no_nested_loops(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["fixed_origin_clusters", "anchor_time_groups", "outlier_range", "anchor_group_totals"])
def test_no_window_has_a_constant_key(spark, name):
    p = plan(spark, name)
    assert "hashpartitioning(1" not in p and "__all" not in p
    assert "SinglePartition" not in p
