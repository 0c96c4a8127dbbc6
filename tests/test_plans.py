"""Plans that matter at scale: pruned scans, pushed filters, limits before the shuffle, no cross joins."""

import re

import pytest

from corpusloom.plans import core_queries


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]


@pytest.mark.parametrize("name", sorted(core_queries.QUERIES))
def test_no_cross_join(spark, small_dir, name):
    p = plan(core_queries.QUERIES[name](spark, small_dir))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize(
    "name, never",
    [("token_counts", "chunk_hash"), ("ingest_pending", "text"), ("discovery_diff", "etag"), ("failed_by_type", "x_none"), ("seed_summary", "text"), ("refresh_outcome", "html"), ("p3_found", "next_check")],
)
def test_columns_are_pruned(spark, small_dir, name, never):
    schemas = re.findall(r"ReadSchema: struct<([^\n]*)>", plan(core_queries.QUERIES[name](spark, small_dir)))
    assert schemas and not any(re.search(rf"\b{never}:", s) for s in schemas)


def test_filters_are_pushed(spark, small_dir):
    p = plan(core_queries.QUERIES["overdue_global"](spark, small_dir))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(snapshot_no,45\)", p)


@pytest.mark.parametrize("name, operator", [("overdue_global", "TakeOrderedAndProject"), ("overdue_per_service", "WindowGroupLimit"), ("retrieve_top_k", "WindowGroupLimit"), ("dedupe_keep_first", "WindowGroupLimit")])
def test_limits_before_the_shuffle(spark, small_dir, name, operator):
    df = core_queries.QUERIES[name](spark, small_dir)
    assert operator in plan(df)
