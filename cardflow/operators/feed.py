"""Transaction feed: entries, as-of actions, recent view (T1-T6, J3, J4, S7,
P15-P18).

Every authorization attempt is a feed entry.  Actions (score, settle,
release) change the entry of their transaction that was *newest when the
action happened*; a score that comes before any entry is kept and applied
to the next entry recorded (forward fallback).  Only a score has the
fallback; settle and release with no entry do nothing.

Plan: entries and actions are one ordered run per transaction
(``operators.asof``): the running number of entries tells each action the
entry that was newest, a score before any entry belongs to the first, and
the state of an entry is a fold over it and its actions.  That is one
shuffle by transaction, linear in entries and actions; a transaction with
very many rows is cut into slices, with carries between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardflow.constants import (
    STAGE_ALERTED, STAGE_ORDER, STAGE_QUEUED, STAGE_RECORDED, STAGE_SCORED, STAGE_SETTLED,
    STATUS_AUTHORIZED, STATUS_HELD, STATUS_SETTLED, STATUSES,
)
from cardflow.functions import display as D
from cardflow.functions.order import code_of, time_id, time_seq, time_seq_time, value_of
from cardflow.functions.text import ntz_lit
from cardflow.operators.asof import running, union_all
from cardflow.operators.lifecycle import KEY
from cardflow.operators.skew import HOT_KEY_ROWS

ENTRY_COLUMNS = ["request_id", "arrival", "transactionId", KEY, "merchantId", "maskedPan",
                 "amount", "currency", "status", "stage", "riskScore", "receiptKey", "updatedAt"]

KIND_SCORE, KIND_RELEASE, KIND_SETTLE = "score", "release", "settle"
# order of kinds taking effect at the same instant (as in the status log)
_SEQ = {KIND_SCORE: 1, KIND_RELEASE: 2, KIND_SETTLE: 3}


def status_as_of(attempts: DataFrame, status_events: DataFrame, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """``attempts`` (with ``KEY`` and arrival) plus ``status_then``: the
    status of the attempt's key at its arrival, NULL before the first event.

    A duplicate attempt shows the stored row as it is at that moment
    (possibly already held or settled).  Attempts and events are one run per
    key; the last status event passes to the attempts behind it.
    """
    ev = status_events.select(KEY, F.col("event_ts").alias("_t"), F.col("seq").cast("long").alias("_seq"),
                              code_of("status", STATUSES).alias("_code"), F.lit(False).alias("_attempt"))
    att = attempts.select("*", F.col("arrival").alias("_t"), F.lit(True).alias("_attempt"))
    rows = att.unionByName(ev, allowMissingColumns=True)
    runs = running(rows, KEY, ["_t", "_attempt", "_seq"], "_then",
                   value=lambda w: F.last("_code", ignorenulls=True).over(w),
                   per_slice=F.max_by("_code", F.when(~F.col("_attempt"), time_seq("_t", "_seq"))),
                   carry=lambda w: F.last("_part", ignorenulls=True).over(w),
                   merge=lambda before, own: F.coalesce(own, before), hot_rows=hot_rows)
    return union_all([r.where("_attempt").select(*attempts.columns, value_of("_then", STATUSES).alias("status_then"))
                      for r in runs])


def entries(outcomes: DataFrame, status_events: DataFrame | None = None,
            hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """One feed entry per attempt (T1 source).

    Stage: QUEUED for a new transaction, RECORDED for a duplicate; the
    status is the stored row's, as of the attempt when ``status_events``
    is given.
    """
    o = outcomes
    status = F.col("status")
    if status_events is not None:
        o = status_as_of(o, status_events, hot_rows)
        status = F.when(F.col("is_new"), F.col("status")).otherwise(F.coalesce(F.col("status_then"), F.col("status")))
    return o.select(
        "request_id", "arrival", "transactionId", KEY, "merchantId", "maskedPan",
        F.col("amount").cast("string").alias("amount"), "currency",
        status.alias("status"),
        F.when(F.col("is_new"), F.lit(STAGE_QUEUED)).otherwise(F.lit(STAGE_RECORDED)).alias("stage"),
        F.lit(None).cast("double").alias("riskScore"),
        "receiptKey",
        F.col("arrival").alias("updatedAt"),
    )


def score_actions(scored: DataFrame) -> DataFrame:
    return scored.select("transactionId", F.col("scored_at").alias("action_ts"),
                         F.lit(KIND_SCORE).alias("kind"), "riskScore", "alerted")


def settle_actions(ids: DataFrame, cutoff) -> DataFrame:
    return ids.select("transactionId", ntz_lit(cutoff).alias("action_ts"),
                      F.lit(KIND_SETTLE).alias("kind"), F.lit(None).cast("double").alias("riskScore"),
                      F.lit(None).cast("boolean").alias("alerted"))


def release_actions(release_requests: DataFrame) -> DataFrame:
    return release_requests.select("transactionId", F.col("released_at").alias("action_ts"),
                                   F.lit(KIND_RELEASE).alias("kind"),
                                   F.lit(None).cast("double").alias("riskScore"),
                                   F.lit(None).cast("boolean").alias("alerted"))


def _segments(entries_df: DataFrame, actions: DataFrame, hot_rows: int) -> list[DataFrame]:
    """Entries and the actions on them, each with the number of its entry
    in its transaction (``_seg``, from 1) and that entry's arrival; actions
    that change no entry are left out."""
    e = entries_df.select("*", F.col("arrival").alias("_t"), F.lit(0).alias("_action"))
    a = actions.where(F.col("transactionId").isNotNull()).select(
        "transactionId", "kind", "action_ts", F.col("riskScore").alias("_action_score"), "alerted",
        F.col("action_ts").alias("_t"), F.lit(1).alias("_action"))
    n = F.lit(1) - F.col("_action")
    # an entry of the action's very time counts as before it
    runs = running(e.unionByName(a, allowMissingColumns=True), "transactionId", ["_t", "_action", "request_id"], "_n",
                   value=lambda w: F.sum(n).over(w), per_slice=F.sum(n), carry=lambda w: F.sum("_part").over(w),
                   merge=lambda before, own: own + F.coalesce(before, F.lit(0)), hot_rows=hot_rows)
    seg = F.when(F.col("_n") > 0, F.col("_n")).when(F.col("kind") == KIND_SCORE, F.lit(1))
    per_entry = Window.partitionBy("transactionId", "_seg")
    return [r.withColumn("_seg", seg).where(F.col("_seg").isNotNull())
            .withColumn("_arrival", F.max("arrival").over(per_entry))
            .withColumn("_eff", F.when(F.col("_n") > 0, F.col("action_ts")).otherwise(F.col("_arrival")))
            for r in runs]


def resolve_targets(entries_df: DataFrame, actions: DataFrame,
                    hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Entry each action applies to.

    Output: kind, transactionId, action_ts, riskScore, alerted,
    target (request_id of the entry), eff_ts (when it took effect: the
    action time, or the entry's arrival for a forward-applied score).
    Actions with no target are dropped.
    """
    per_entry = Window.partitionBy("transactionId", "_seg")
    return union_all([
        r.withColumn("target", F.max("request_id").over(per_entry)).where("_action = 1 AND target IS NOT NULL")
        .select("kind", "transactionId", "action_ts", F.col("_action_score").alias("riskScore"), "alerted", "target",
                F.col("_eff").alias("eff_ts")) for r in _segments(entries_df, actions, hot_rows)])


def apply_actions(entries_df: DataFrame, actions: DataFrame,
                  hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Entries after every action took effect, in time order.

    score: riskScore set; ALERTED + HELD_FOR_REVIEW when alerted, else
    SCORED with the status unchanged.  settle: SETTLED/SETTLED.  release:
    AUTHORIZED/SCORED.
    """
    seq = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in _SEQ.items()])
    stage = (F.when(F.col("kind") == KIND_SETTLE, F.lit(STAGE_SETTLED))
             .when(F.col("kind") == KIND_RELEASE, F.lit(STAGE_SCORED))
             .when(F.col("alerted"), F.lit(STAGE_ALERTED)).otherwise(F.lit(STAGE_SCORED)))
    status = (F.when(F.col("kind") == KIND_SETTLE, F.lit(STATUS_SETTLED))
              .when(F.col("kind") == KIND_RELEASE, F.lit(STATUS_AUTHORIZED))
              .when(F.col("alerted"), F.lit(STATUS_HELD)))
    # effect order: time it took effect, action kind, then the action's own
    # time (several early scores on one entry: the last one wins), packed
    # into one number (NULL for the entry itself); values as small codes
    acts = F.col("_action") == 1
    order = F.when(acts, time_seq_time("_eff", seq, "action_ts"))
    per_entry = Window.partitionBy("transactionId", "_seg")
    done = [(r.withColumn("_stage", F.max_by(code_of(stage, STAGE_ORDER), order).over(per_entry))
             .withColumn("_status", F.max_by(code_of(status, STATUSES), F.when(status.isNotNull(), order)).over(per_entry))
             .withColumn("_score", F.max_by("_action_score", F.when(F.col("kind") == KIND_SCORE, order)).over(per_entry))
             .withColumn("_updated", F.max(F.when(acts, F.col("_eff"))).over(per_entry))
             .where("_action = 0")) for r in _segments(entries_df, actions, hot_rows)]
    return union_all(done).select(
        "request_id", "arrival", "transactionId", KEY, "merchantId", "maskedPan", "amount",
        "currency",
        F.coalesce(value_of("_status", STATUSES), F.col("status")).alias("status"),
        F.coalesce(value_of("_stage", STAGE_ORDER), F.col("stage")).alias("stage"),
        F.coalesce(F.col("_score"), F.col("riskScore")).alias("riskScore"),
        "receiptKey",
        F.coalesce(F.col("_updated"), F.col("updatedAt")).alias("updatedAt"),
    )


def recent(feed: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` entries, newest first.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps
    its own top n, and only n rows per task reach the final merge; the
    bound is the feature, not a way around data size.
    """
    return feed.orderBy(F.col("arrival").desc(), F.col("request_id").desc()).limit(n)


def newest_entry(feed: DataFrame, ids: DataFrame) -> DataFrame:
    """Newest entry per requested transaction id; ids with none are kept
    with ``found`` false (T6, J4)."""
    newest = feed.groupBy("transactionId").agg(
        F.max_by("request_id", time_id("arrival", "request_id")).alias("newest_id"))
    return (ids.join(newest, "transactionId", "left")
            .select("transactionId", F.col("newest_id").alias("request_id"),
                    F.col("newest_id").isNotNull().alias("found")))


def display(feed: DataFrame) -> DataFrame:
    """Dashboard columns for feed rows."""
    return feed.select(
        "request_id", "transactionId",
        D.short_id("transactionId").alias("shortId"),
        "merchantId", "maskedPan",
        D.amount_label("amount", "currency").alias("amountLabel"),
        F.lower("stage").alias("stageLabel"),
        D.stage_rank("stage").alias("stageRank"),
        D.risk_percent("riskScore").alias("riskPercent"),
        D.risk_label("riskScore").alias("riskLabel"),
        F.coalesce(D.risk_high("riskScore"), F.lit(False)).alias("riskHigh"),
        D.receipt_name("receiptKey").alias("receiptName"),
        D.empty_if_null("receiptKey").alias("receiptKey"),
        D.row_class("status", "stage").alias("rowClass"),
        D.can_release("stage").alias("canRelease"),
    )


def ticker(feed: DataFrame) -> DataFrame:
    """Stages lit on the ticker: those up to the newest entry's stage (A4)."""
    newest = recent(feed, 1)
    stages = F.array(*[F.lit(s) for s in
                       [STAGE_RECORDED, STAGE_QUEUED, STAGE_SCORED, STAGE_ALERTED, STAGE_SETTLED]])
    return (newest.select(F.col("stage").alias("newest_stage"),
                          F.posexplode(stages).alias("pos", "stage"))
            .select("stage", (F.col("pos") <= D.stage_rank("newest_stage")).alias("lit"),
                    ((F.col("stage") == F.col("newest_stage")) &
                     (F.col("newest_stage") == STAGE_ALERTED)).alias("alert")))


# names used in the operator inventory
recent_feed = recent
feed_display = display
