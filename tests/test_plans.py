"""Physical-plan properties the design relies on at scale."""

import re

from conftest import SF01
from tierlake.operators import quality
from tierlake.operators.dedupe import dedupe
from tierlake.plans import catalog, catalog_dims, catalog_ops


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def below_first_exchange(text: str, node: str) -> bool:
    """``node`` occurs in the subtree under the first shuffle exchange
    (i.e. it runs map-side, before the data moves)."""
    lines = text.splitlines()
    first = next(i for i, ln in enumerate(lines) if "Exchange hashpartitioning" in ln)
    return any(node in ln for ln in lines[first + 1:])


def test_dedupe_limits_map_side(spark):
    p = plan(dedupe(catalog.table(spark, SF01, "lineitem"), ["l_orderkey", "l_linenumber"],
                    order_by=[]))
    assert p.count("WindowGroupLimit") == 2 and below_first_exchange(p, "WindowGroupLimit")
    assert "SortAggregate" not in p


def test_fact_mart_one_shuffle_and_broadcast_fx(spark):
    p = plan(catalog.fact_mart(spark, SF01))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_keyed_profile_partial_aggregation(spark):
    p = plan(quality.profile(catalog.table(spark, SF01, "lineitem"),
                             quality.Checks(keys=("l_orderkey", "l_linenumber"))))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert "partial_count" in p and below_first_exchange(p, "partial_count")
    # only the key columns are read
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>", p)


def test_filter_pushed_to_scan(spark):
    p = plan(catalog.dq_empty(spark, SF01))
    assert re.search(r"PushedFilters: \[[^\]]*l_shipdate", p)


def test_latest_per_group_limits_map_side(spark):
    p = plan(catalog_ops.latest_failure(spark, SF01))
    assert below_first_exchange(p, "WindowGroupLimit")
    assert re.search(r"PushedFilters: \[[^\]]*event_type", p)


def test_region_lookup_broadcasts_fixed_map(spark):
    p = plan(catalog_dims.region_lookup(spark, SF01))
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p
