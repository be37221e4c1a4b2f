"""Physical plan shape: what must hold at scale, checked on the small data."""

import pytest

from conftest import SF_SMALL
from deskpark.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan(q(spark, SF_SMALL)) for k, q in registry.queries().items()}


def test_no_cross_or_nested_loop_joins(plans):
    bad = {k for k, p in plans.items() if "CartesianProduct" in p or "NestedLoopJoin" in p}
    assert not bad


def test_filters_reach_the_scan(plans):
    p = plans["latest_escalation"]
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)" in p
    p = plans["identity_upsert"]
    assert "EqualTo(event_type,purchase)" in p


def test_scans_read_only_needed_columns(plans):
    # the ticket binding never needs order prices or line quantities
    for k in ("ticket_hydrate", "analyst_inbox", "status_apply"):
        assert "o_totalprice" not in plans[k] and "l_quantity" not in plans[k]
    assert "p_retailprice" not in plans["ticket_cards"] and "c_acctbal" not in plans["user_context"]


def test_literal_top_k_is_limited_before_the_shuffle(plans):
    for k in ("recent_tickets", "kb_topk"):
        assert "WindowGroupLimit" in plans[k], k


def test_inbox_ranks_without_a_window_over_a_list(plans):
    # ranks come from a written distributed sort: no row_number over an analyst's tickets, at any offset
    assert "row_number()" not in plans["analyst_inbox"]


def test_no_python_udfs(plans):
    for k, p in plans.items():
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, k


def test_unanswered_shuffles_distinct_words_not_texts(spark, small):
    from deskpark.operators import retrieval as RT
    plan = RT.kb_unanswered(small.kb_document, small.kb_question)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    texts = next(i for i, x in enumerate(lines) if "Generate" in x and "filter(split(lower(text" in x)
    above = next(x for x in reversed(lines[:texts]) if "Aggregate" in x or "Exchange" in x)
    assert "RoundRobinPartitioning" not in plan and "Aggregate" in above, plan
