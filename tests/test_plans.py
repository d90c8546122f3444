"""Plan review as tests: properties every registered query's physical plan must keep."""

import pytest

import __spark_entry__ as entry

from conftest import SF_SMALL

QUERIES = entry.queries()


def plan_of(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_stored_index_lookup_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(embedding), In(doc_id," in plan_of(spark, "search_stored_index")


def test_latest_per_key_aggregates_before_the_shuffle(spark):
    plan = plan_of(spark, "latest_event_per_user")
    assert plan.count("SortAggregate") + plan.count("HashAggregate") >= 2   # partial + final


def test_search_has_one_shuffle_and_a_partial_limit(spark):
    plan = plan_of(spark, "search_questions")
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan
    assert plan.count("Exchange hashpartitioning") == 1
