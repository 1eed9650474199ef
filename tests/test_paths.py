"""Queries over fused paths: none of them makes a row for every pair of a path and a point."""

import pytest

from quillstone import catalog

SF = "/root/testdata/sf0.001"

NAMES = [
    "result_checks",
    "rerank_dispatch",
    "min_floor",
    "collection_guarantee",
    "overlap_report",
    "fallback_scores",
    "greedy_pack",
    "pool_allocation",
    "eval_summary",
    "collection_relevance",
    "quota_cap",
]


@pytest.mark.parametrize("name", NAMES)
def test_pairs_are_no_rows(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" not in plan and plan.count("MapInArrow") <= 1
