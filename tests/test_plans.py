"""Plans are the ones intended: filters and columns reach the scan, limits and ranks cut before the shuffle."""

import contextlib
import io

import pytest

from loomwork.plans.catalogue import registry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.queries[name](spark, SF).explain("formatted")
    return out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "scan_pushdown")
    assert "GreaterThanOrEqual(l_quantity,45.0)" in p and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p and "Exchange" not in p


def test_flagship_reads_what_it_needs(spark):
    p = plan(spark, "revenue_by_region_month")
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in p
    assert "GreaterThanOrEqual(o_orderdate" in p and "Cartesian" not in p


def test_top_k_needs_no_sort_of_all(spark):
    assert "TakeOrderedAndProject" in plan(spark, "top_k")


def test_ranks_are_cut_below_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "win_top_of_each")


@pytest.mark.parametrize("name", ["item_similarity", "join_asof", "fraud_scores", "cep_followed_by", "cdc_diff", "join_range", "dq_iqr_outliers"])
def test_no_products(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_aggregates_combine_before_the_shuffle(spark):
    assert "partial_sum" in plan(spark, "agg_pricing_summary")
