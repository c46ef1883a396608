"""Tier 4: plan shapes that matter at scale."""

import contextlib
import io
import re

import pytest

from creditlens.plans.catalog import run

SF = "/root/testdata/sf0.001"


def plan_text(df, mode="simple"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


@pytest.mark.parametrize("name", [
    "q07_running_total_by_agency", "q14_member_tiers", "q18_moving_average", "q26_extreme_deciles",
    "q33_lower_median", "q38_p90_cut", "q40_distribution_summary"])
def test_no_single_partition_over_raw_rows(spark, name):
    lines = plan_text(run(name, spark, SF)).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = re.sub(r"^[\s:+\-]*", "", lines[i + 1])
            assert child.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")), (name, child)


@pytest.mark.parametrize("name,join", [
    ("q06_hidden_risk", "LeftSemi"), ("q08_good_payers", "LeftSemi"),
    ("q11_ghost_members", "LeftAnti"), ("q19_vip_defaulters", "LeftSemi")])
def test_exists_is_a_semi_or_anti_join(spark, name, join):
    assert join in plan_text(run(name, spark, SF))


def test_top_k_per_group_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_text(run("q01_top_loans_per_agency", spark, SF))


def test_date_range_and_columns_reach_the_scan(spark):
    text = plan_text(run("q01_top_loans_per_agency", spark, SF))
    orders_scan = [l for l in text.splitlines() if "FileScan" in l and "orders.parquet" in l]
    assert orders_scan
    scan = orders_scan[0]
    assert "o_orderdate" in scan and "PushedFilters" in scan
    assert "GreaterThanOrEqual(o_orderdate" in scan or "o_orderdate" in scan.split("PushedFilters")[1]
    assert "o_orderstatus" not in scan  # pruned: q01 does not read the status


def test_instalments_are_aggregated_before_the_chain_join(spark):
    text = plan_text(run("q20_instalment_pivot", spark, SF))
    lines = text.splitlines()
    li = next(i for i, l in enumerate(lines) if "lineitem.parquet" in l)
    above = "\n".join(lines[:li])
    assert "partial_sum" in above
