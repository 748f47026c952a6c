import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from cardflow.operators import lifecycle as L
from cardflow.operators import settlement as S
from cardflow.operators.authorize import authorize, new_rows, normalize_requests
from cardflow.operators.scoring import fraud_alerts, score
from tests.helpers import at, req, requests_df


def ledger(spark, rows):
    valid, _ = normalize_requests(requests_df(spark, rows))
    return new_rows(authorize(valid))


def test_high_value_held_and_left_out_of_settlement(spark):
    stored = ledger(spark, [req(1, 1, amount="4999.00", key="hi"), req(2, 2, amount="4.50", key="lo")])
    scored = score(stored).withColumn("scored_at", F.col("createdAt") + F.expr("INTERVAL 1 SECOND"))
    a = fraud_alerts(scored).collect()
    assert len(a) == 1 and a[0].severity == "CRITICAL" and a[0].riskScore == 0.92
    ev = L.authorize_events(stored).unionByName(L.hold_events(scored))
    cur = L.current_rows(stored, ev, at(100))
    st = {r.idempotencyKey: r.status for r in cur.collect()}
    assert st == {"hi": "HELD_FOR_REVIEW", "lo": "AUTHORIZED"}
    t = S.totals(cur).first()
    assert (t.transactionCount, t.totalAmount) == (1, Decimal("4.50"))


def test_hold_release_settle_in_second_batch(spark):
    stored = ledger(spark, [req(1, 1, amount="4999.00", key="hi")])
    scored = score(stored).withColumn("scored_at", F.col("createdAt"))
    ev = L.authorize_events(stored).unionByName(L.hold_events(scored))
    cur1 = L.current_rows(stored, ev, at(10))
    assert S.totals(cur1).first().transactionCount == 0
    entries = stored.select("transactionId", "idempotencyKey", F.col("createdAt").alias("arrival"))
    rel_req = stored.select("transactionId", F.lit(str(at(20))).cast("timestamp_ntz").alias("released_at"))
    rel_ev, nf = L.release(rel_req, entries)
    assert nf.count() == 0
    ev2 = ev.unionByName(L.settle_events(cur1, at(10))).unionByName(rel_ev)
    cur2 = L.current_rows(stored, ev2, at(30))
    assert [r.status for r in cur2.collect()] == ["AUTHORIZED"]
    t = S.totals(cur2).first()
    assert (t.transactionCount, t.totalAmount) == (1, Decimal("4999.00"))


def test_unknown_release_is_not_found(spark):
    stored = ledger(spark, [req(1, 1)])
    entries = stored.select("transactionId", "idempotencyKey", F.col("createdAt").alias("arrival"))
    rel = spark.createDataFrame([("nope", at(5))], "transactionId string, released_at timestamp_ntz")
    ev, nf = L.release(rel, entries)
    assert ev.count() == 0 and [r.transactionId for r in nf.collect()] == ["nope"]


def test_status_update_missing_key(spark):
    stored = ledger(spark, [req(1, 1, key="a")])
    upd = spark.createDataFrame([("a", at(5)), ("zz", at(5))], "idempotencyKey string, event_ts timestamp_ntz")
    ev, missing = L.status_update(stored, upd, "SETTLED")
    assert [r.idempotencyKey for r in ev.collect()] == ["a"]
    assert [r.idempotencyKey for r in missing.collect()] == ["zz"]


def test_empty_batch_summary(spark):
    stored = ledger(spark, [req(1, 1)])
    ev = L.authorize_events(stored).unionByName(L.settle_events(L.current_rows(
        stored, L.authorize_events(stored), at(5)), at(5)))
    cur = L.current_rows(stored, ev, at(6))
    s = S.summary(cur, "batch-x", dt.datetime(2024, 1, 2)).first()
    assert (s.transactionCount, s.totalAmount) == (0, Decimal("0.00"))
    assert s.message == "Settled 0 transaction(s) totaling 0"
    assert s.batchSummaryKey == "settlements/batch-x.json"


def test_mixed_currency_totals(spark):
    stored = ledger(spark, [req(1, 1, amount="10", key="a", currency="USD"),
                            req(2, 2, amount="5", key="b", currency="EUR")])
    cur = L.current_rows(stored, L.authorize_events(stored), at(10))
    assert S.totals(cur).first().totalAmount == Decimal("15.00")
    by = {r.currency: r.totalAmount for r in S.totals(cur, by_currency=True).collect()}
    assert by == {"USD": Decimal("10.00"), "EUR": Decimal("5.00")}


def test_find_by_status_oldest_first(spark):
    stored = ledger(spark, [req(1, 3, key="c"), req(2, 1, key="a"), req(3, 2, key="b")])
    cur = L.current_rows(stored, L.authorize_events(stored), at(10))
    assert [r.idempotencyKey for r in L.find_by_status(cur, "AUTHORIZED").collect()] == ["a", "b", "c"]


def test_invariants_on_sf0001(spark):
    from cardflow.plans.context import CUTOFF, FIRST_CUTOFF, Pipeline
    from tests.conftest import SF001
    p = Pipeline(spark, SF001)
    settled1 = p.batch1_events.select("idempotencyKey")
    held_at_1 = p.batch1_current.where("status = 'HELD_FOR_REVIEW'").select("idempotencyKey")
    assert settled1.join(held_at_1, "idempotencyKey").count() == 0  # settled ∩ held = ∅
    t1 = S.totals(p.batch1_current).first().totalAmount
    t2 = S.totals(p.batch2_current).first().totalAmount
    settled_all = p.all_events.where("status = 'SETTLED'").join(
        p.stored.select("idempotencyKey", "amount"), "idempotencyKey")
    assert settled_all.agg(F.sum("amount")).first()[0] == t1 + t2
    assert p.outcomes.where("outcome = 'APPROVED'").count() == \
        p.requests.select("idempotencyKey").distinct().count()
    assert CUTOFF > FIRST_CUTOFF


def test_guarded_release_only_for_held(spark):
    stored = ledger(spark, [req(1, 1, amount="4999.00", key="hi"), req(2, 2, key="lo")])
    scored = score(stored).withColumn("scored_at", F.col("createdAt"))
    ev = L.authorize_events(stored).unionByName(L.hold(scored))
    cur = L.current_rows(stored, ev, at(10))
    entries = stored.select("transactionId", "idempotencyKey", F.col("createdAt").alias("arrival"))
    rel = stored.select("transactionId", F.lit(str(at(20))).cast("timestamp_ntz").alias("released_at"))
    free, _ = L.release(rel, entries)
    guarded, _ = L.release(rel, entries, current=cur, guarded=True)
    assert free.count() == 2
    assert [r.idempotencyKey for r in guarded.collect()] == ["hi"]


def test_pluggable_pandas_score(spark):
    from cardflow.operators.scoring import pandas_score_fn
    stored = ledger(spark, [req(1, 1, amount="10.00", key="a"), req(2, 2, amount="90.00", key="b")])
    fn = pandas_score_fn(lambda pdf: (pdf["amount"].astype(float) / 100.0).values, ["amount"])
    got = {r.idempotencyKey: (r.riskScore, r.alerted) for r in score(stored, fn).collect()}
    assert got == {"a": (0.1, False), "b": (0.9, True)}


def test_settlement_notice_rows(spark):
    stored = ledger(spark, [req(1, 1, amount="10.00", key="a"), req(2, 2, amount="5.00", key="b")])
    cur = L.current_rows(stored, L.authorize_events(stored), at(10))
    n = S.settlement_notice(S.summary(cur, "batch-1", dt.datetime(2024, 1, 2))).first()
    assert n.subject == "Settlement batch complete: batch-1"
    assert n.message == "Settled 2 transaction(s) totaling 15.00"


def test_find_one_and_settle_by_currency(spark):
    stored = ledger(spark, [req(1, 1, amount="10", key="a", currency="USD"),
                            req(2, 2, amount="5", key="b", currency="EUR")])
    cur = L.current_rows(stored, L.authorize_events(stored), at(10))
    assert [r.amount for r in L.find(cur, "b").collect()] == [Decimal("5.00")]
    assert L.find(cur, "zz").count() == 0
    ev, head, ids = S.settle(cur, at(10), "batch-c", by_currency=True)
    assert {r.currency: r.totalAmount for r in head.collect()} == {"USD": Decimal("10.00"),
                                                                 "EUR": Decimal("5.00")}
    assert ev.count() == 2 and ids.count() == 2


def test_sql_views(spark):
    from cardflow.plans.context import Pipeline
    from tests.conftest import SF001
    names = Pipeline(spark, SF001).register_views(prefix="cf_")
    assert "cf_authorizations" in names
    n = spark.sql("SELECT count(*) FROM cf_authorizations WHERE status = 'AUTHORIZED'").first()[0]
    assert n == 792
    held = spark.sql("""SELECT count(DISTINCT idempotencyKey) FROM cf_status_events
                        WHERE status = 'HELD_FOR_REVIEW'""").first()[0]
    assert held == 157


def test_hold_after_settlement_faithful_and_guarded(spark):
    stored = ledger(spark, [req(1, 1, amount="4999.00", key="hi")])
    # settled at t=10, scored (and held) only at t=20
    scored = score(stored).withColumn("scored_at", F.lit(str(at(20))).cast("timestamp_ntz"))
    base = L.authorize_events(stored)
    settled = L.settle_events(L.current_rows(stored, base, at(10)), at(10))
    ev = base.unionByName(settled).unionByName(L.hold(scored))
    assert [r.status for r in L.current_status(ev, at(30)).collect()] == ["HELD_FOR_REVIEW"]
    assert [r.status for r in L.current_status(ev, at(30), guarded=True).collect()] == ["SETTLED"]
