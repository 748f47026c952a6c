"""Plan-shape guards for every registered query (sf0.001)."""

import pytest

import __spark_entry__ as E
from cardflow.plans import catalog
from cardflow.plans.context import Pipeline
from tests.conftest import SF001

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_pairs_and_no_python(spark, name):
    df = E.queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_attempt_is_one_partial_aggregation(spark):
    from cardflow.operators.authorize import resolution
    p = Pipeline(spark, SF001, materialize=False)
    plan = plan_of(resolution(p.valid))
    # a row per key and task reaches the one shuffle, with the winner's row in it
    assert "partial_min_by" in plan and "Join" not in plan and plan.count("Exchange") == 1


def test_authorize_moves_attempts_once(spark):
    p = Pipeline(spark, SF001, materialize=False)
    plan = plan_of(p.outcomes_plan)  # nothing of it is a written result
    assert "Aggregate" not in plan and "Window" not in plan
    # attempts and their resolution, both scans of written tables: AQE can split a hot key
    assert plan.count("Scan parquet") == 2 and plan.count("Join") == 1 and plan.count("Exchange") <= 2


def test_feed_is_one_run_per_transaction(spark):
    p = Pipeline(spark, SF001, materialize=False)
    e, acts = p._cut(p.entries, "e"), p.feed_actions
    from cardflow.operators.feed import apply_actions
    from cardflow.session import materialize
    plan = plan_of(apply_actions(materialize(e, "entries"), materialize(acts, "actions")))
    # entries and actions meet in one shuffle by transaction, without a join
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(transactionId") == plan.count("Exchange") == 1
    assert "SortAggregate" not in plan


def test_recent_feed_is_take_ordered(spark):
    plan = E.queries()["feed_recent_100"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_scan_reads_only_needed_columns(spark):
    df = E.queries()["velocity_tumbling"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan or \
        "props" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_cutoff_filters_reach_the_materialized_scans(spark):
    df = E.queries()["settlement_totals"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = [l[l.index("PushedFilters"):] for l in plan.split("\n") if "PushedFilters" in l]
    assert any("LessThanOrEqual(createdAt" in p and "EqualTo(is_new,true)" in p for p in pushed)
    assert any("LessThanOrEqual(event_ts" in p for p in pushed)
    # column pruning: the ledger scan reads four columns, not all of them
    assert any("ReadSchema: struct<is_new:boolean,idempotencyKey:string,amount:decimal(18,2),"
               "createdAt:timestamp_ntz>" in p for p in pushed)
