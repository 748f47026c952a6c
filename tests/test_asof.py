"""Actions on entries and statuses of attempts as ordered runs: linear in
both sides, exact where a key is cut into slices."""
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from cardflow.operators import feed as FD
from cardflow.operators.asof import running, union_all
from tests.helpers import at

ENTRY = ("request_id long, arrival timestamp_ntz, transactionId string, idempotencyKey string, merchantId string, "
         "maskedPan string, amount string, currency string, status string, stage string, riskScore double, "
         "receiptKey string, updatedAt timestamp_ntz")
ACTION = "transactionId string, action_ts timestamp_ntz, kind string, riskScore double, alerted boolean"


def entries_df(spark, rows):
    return spark.createDataFrame([(i, at(s), t, t, "m", "c", "1", "USD", "AUTHORIZED", "QUEUED", None, None, at(s))
                                  for i, s, t in rows], ENTRY)


def actions_df(spark, rows):
    return spark.createDataFrame([(t, at(s), k, r, a) for t, s, k, r, a in rows], ACTION)


def brute(entries, actions):
    """Each action on the newest entry of its time, a score before any on
    the first; effects of an entry in order of effect, kind and action time."""
    by_txn = {}
    for i, s, t in sorted(entries, key=lambda e: (e[1], e[0])):
        by_txn.setdefault(t, []).append((s, i))
    effects = {}
    for t, s, kind, score, alerted in actions:
        es = by_txn.get(t, [])
        n = bisect_right(es, (s, float("inf")))
        if n:
            target, eff = es[n - 1][1], s
        elif kind == "score" and es:
            target, eff = es[0][1], es[0][0]
        else:
            continue
        effects.setdefault(target, []).append((eff, {"score": 1, "release": 2, "settle": 3}[kind], s, kind, score, alerted))
    out = {}
    for i, s, t in entries:
        stage, status, risk, updated = "QUEUED", "AUTHORIZED", None, s
        for eff, _, _, kind, score, alerted in sorted(effects.get(i, []), key=lambda e: e[:3]):
            if kind == "settle":
                stage, status = "SETTLED", "SETTLED"
            elif kind == "release":
                stage, status = "SCORED", "AUTHORIZED"
            else:
                risk = score
                stage = "ALERTED" if alerted else "SCORED"
                status = "HELD_FOR_REVIEW" if alerted else status
            updated = eff
        out[i] = (stage, status, risk, at(updated))
    return out


def got(df):
    return {r.request_id: (r.stage, r.status, r.riskScore, r.updatedAt) for r in df.collect()}


def data(rng, n_entries, n_actions, hot):
    txns = [f"t{k}" for k in range(40)]
    pick = lambda: "HOT" if rng.random() < hot else rng.choice(txns)
    entries = [(i, rng.randrange(2000) / 4, pick()) for i in range(n_entries)]
    times = set()
    actions = []
    for _ in range(n_actions):
        t, s = pick(), rng.randrange(8000) / 16
        if (t, s) in times:
            continue  # two actions of one instant and kind have no order
        times.add((t, s))
        k = rng.choice(["score", "score", "release", "settle"])
        actions.append((t, s, k, rng.choice([0.15, 0.92]) if k == "score" else None, rng.random() < .5 if k == "score" else None))
    return entries, actions


@pytest.mark.parametrize("hot_rows", [10**9, 50])
def test_actions_against_replay(spark, hot_rows):
    entries, actions = data(random.Random(1), 400, 600, .3)
    actions += [("none", 5.0, "score", 0.92, True), (None, 5.0, "score", 0.92, True)]
    f = FD.apply_actions(entries_df(spark, entries).repartition(3), actions_df(spark, actions), hot_rows=hot_rows)
    assert got(f) == brute(entries, actions)


def test_a_third_of_the_entries_and_ten_thousand_actions(spark):
    rng = random.Random(2)
    entries = [(i, i / 8, "HOT" if i % 3 == 0 else f"t{i}") for i in range(6000)]
    actions = [("HOT", j / 13 + 0.003, rng.choice(["score", "release", "settle"]), 0.5, False) for j in range(10_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        f = FD.apply_actions(entries_df(spark, entries), actions_df(spark, actions), hot_rows=1000)
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert got(f) == brute(entries, actions)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert "_salt" not in plan
    # rows that pass any operator stay linear: no operator of the cold branch joins entries with actions
    cold = FD.apply_actions(entries_df(spark, entries), actions_df(spark, actions))
    assert "Join" not in cold._jdf.queryExecution().optimizedPlan().toString()


def test_slices_are_cut_by_rows(spark):
    rows = spark.range(4000).select(F.lit("k").alias("k"), F.col("id"), (F.col("id") % 2).alias("flag"))
    parts = running(rows, "k", ["id"], "n", value=lambda w: F.sum("flag").over(w), per_slice=F.sum("flag"),
                    carry=lambda w: F.sum("_part").over(w), merge=lambda b, o: o + F.coalesce(b, F.lit(0)), hot_rows=100)
    assert len(parts) == 2
    assert [r.n for r in union_all(parts).orderBy("id").collect()] == [(i + 1) // 2 for i in range(4000)]


@pytest.mark.parametrize("hot_rows", [10**9, 20])
def test_status_as_of_against_replay(spark, hot_rows):
    rng = random.Random(3)
    keys = ["HOT", "HOT", "a", "b", "c"]
    attempts = [(i, rng.choice(keys), rng.randrange(100)) for i in range(200)]
    events = [(rng.choice(keys), rng.choice(["AUTHORIZED", "HELD_FOR_REVIEW", "SETTLED"]), s, q)
              for s, q in {(rng.randrange(100), rng.randrange(4)) for _ in range(60)}]
    att = spark.createDataFrame([(i, k, at(s)) for i, k, s in attempts], "request_id long, idempotencyKey string, arrival timestamp_ntz")
    ev = spark.createDataFrame([(k, st, at(s), q) for k, st, s, q in events],
                               "idempotencyKey string, status string, event_ts timestamp_ntz, seq long")
    want = {}
    for i, k, s in attempts:
        before = [(es, q, st) for ek, st, es, q in events if ek == k and es <= s]
        want[i] = max(before)[2] if before else None
    assert {r.request_id: r.status_then for r in FD.status_as_of(att, ev, hot_rows).collect()} == want
