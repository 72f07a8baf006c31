"""Properties of the physical plans."""

import pytest

from recordloom.plans import analytics, choices, entities, evaluation, feed, passages, relational, stories, streams, texts  # noqa: F401 - they register their queries
from recordloom.plans.registry import QUERIES

#: Joins with a table of one row of totals.
WITH_TOTALS = {
    "b_cubed", "label_agreement", "common_name_cut", "title_idf_cosine", "headline_best_match", "pair_confusion", "exact_set_marking", "pagination", "entity_df_idf",
    "percentile_mapping",  # four thresholds against distinct rounded scores
}


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_unbounded_nested_loops_or_row_udfs(name, spark, tiny):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name in WITH_TOTALS


def test_filters_and_columns_reach_the_scan(spark, tiny):
    plan = QUERIES["has_claims"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_extendedprice" not in plan


def test_top_k_is_pruned_before_the_shuffle(spark, tiny):
    plan = QUERIES["feed_ranked"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
