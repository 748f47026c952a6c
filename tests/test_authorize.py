from decimal import Decimal

from pyspark.sql import functions as F

from cardflow.operators.authorize import authorize, new_rows, normalize_requests
from tests.helpers import req, requests_df


def run(spark, rows, ledger=None, batch_id=None):
    valid, rejected = normalize_requests(requests_df(spark, rows))
    out = authorize(valid, ledger=ledger, batch_id=batch_id)
    return out, rejected


def test_retry_is_duplicate_with_same_transaction(spark):
    out, _ = run(spark, [req(1, 1), req(2, 5)])
    rows = {r.request_id: r for r in out.collect()}
    assert rows[1].outcome == "APPROVED" and rows[1].receiptKey.startswith("receipts/merchant-7/")
    assert rows[2].outcome == "DUPLICATE" and rows[2].receiptKey is None
    assert rows[1].transactionId == rows[2].transactionId
    assert new_rows(out).count() == 1


def test_retry_with_other_payload_keeps_first(spark):
    out, _ = run(spark, [req(1, 1, amount="4.50"), req(2, 2, amount="9.99")])
    assert {r.amount for r in out.collect()} == {Decimal("4.50")}
    assert [r.amount for r in new_rows(out).collect()] == [Decimal("4.50")]


def test_tie_on_arrival_broken_by_request_id(spark):
    out, _ = run(spark, [req(7, 1, amount="7.00"), req(3, 1, amount="3.00")])
    win = out.where("outcome = 'APPROVED'").first()
    assert win.request_id == 3 and win.amount == Decimal("3.00")


def test_ledger_across_batches_and_replay(spark):
    first, _ = run(spark, [req(1, 1, key="a"), req(2, 2, key="b")])
    ledger = new_rows(first).withColumn("batch_id", F.lit("0"))
    second, _ = run(spark, [req(3, 10, key="a"), req(4, 11, key="c")], ledger=ledger, batch_id="1")
    got = {r.request_id: r.outcome for r in second.collect()}
    assert got == {3: "DUPLICATE", 4: "APPROVED"}
    # replaying batch 0 against a ledger that already holds batch 0's rows
    replay, _ = run(spark, [req(1, 1, key="a"), req(2, 2, key="b")], ledger=ledger, batch_id="0")
    assert {r.outcome for r in replay.collect()} == {"APPROVED"}


def test_rejects_and_generated_keys(spark):
    rows = [req(1, 1, merchant=" ", pan="41111111111", amount=None),
            req(2, 2, amount="abc"), req(3, 3, key=""), req(4, 4, key=" ")]
    out, rejected = run(spark, rows)
    errs = {r.request_id: r.error for r in rejected.collect()}
    assert errs[1] == "Missing/invalid fields: merchantId, pan (12+ digits), amount"
    assert errs[2] == "Invalid amount: abc"
    ok = out.collect()
    assert {r.request_id for r in ok} == {3, 4}
    assert all(r.outcome == "APPROVED" for r in ok)  # blank keys never collide


def test_approved_equals_distinct_keys(spark):
    rows = [req(i, i, key=f"k{i % 7}") for i in range(50)]
    out, _ = run(spark, rows)
    assert out.where("outcome = 'APPROVED'").count() == 7
    assert out.count() == 50


def test_plan_has_no_window_on_key(spark):
    out, _ = run(spark, [req(1, 1), req(2, 2)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert "Aggregate" not in plan  # the first attempts are a written table
