"""Registered queries: a Spark builder and, where SQL can say it, the
equivalent DuckDB SQL over the same parquet tables.

Every builder reads the scale-factor folder's tables (or what Spark
derives from them), so its work grows with the data; nothing is sampled
or capped except where the limit is the feature (the 100-row feed).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.plans import sql as Q
from cardflow.plans.context import (
    BATCH_1, CUTOFF, EMPTY_BATCH, FIRST_CUTOFF, Pipeline,
)
from cardflow.operators import authorize as A
from cardflow.operators import feed as FD
from cardflow.operators import lifecycle as L
from cardflow.operators import settlement as S
from cardflow.operators.ordering import numbered
from cardflow.operators.scoring import severity_counts
from cardflow.functions.pan import mask_pan, strip_spaces
from cardflow.functions.requests import BLANKS, FORM_SPACES, parse_amount

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (lambda spark, sf_dir: fn(Pipeline.shared(spark, sf_dir)), sql)
        return fn
    return deco


CUT = CUTOFF.strftime("%Y-%m-%d %H:%M:%S")
CUT1 = FIRST_CUTOFF.strftime("%Y-%m-%d %H:%M:%S")

# ---------------------------------------------------------------------------
# minimum slice (entry)
# ---------------------------------------------------------------------------


@query("merchant_summary", Q.BASE_SC + """
SELECT merchantId,
       count(*) AS authorized,
       count(*) FILTER (WHERE alerted) AS held,
       count(*) FILTER (WHERE NOT alerted) AS settled,
       CAST(coalesce(sum(amount) FILTER (WHERE NOT alerted), 0) AS DECIMAL(38,2)) AS total
FROM sc GROUP BY merchantId""")
def merchant_summary(p: Pipeline) -> DataFrame:
    return p.merchant_summary()


# ---------------------------------------------------------------------------
# requests: P1, P4-P7
# ---------------------------------------------------------------------------


# both white-space sets, written out in the SQL as characters
_PAN = f"translate(pan, '{FORM_SPACES}', '')"
_BLANK = "({c} IS NULL OR translate({c}, '" + BLANKS + "', '') = '')"


@query("mask_pan", Q.with_(Q.REQ, Q.RAW) + f"""
SELECT request_id, {_PAN} AS pan_clean,
       CASE WHEN length({_PAN}) >= 4 THEN '**** **** **** ' || right({_PAN}, 4) END AS maskedPan
FROM raw""")
def q_mask_pan(p: Pipeline) -> DataFrame:
    r = p.raw_requests
    return r.select("request_id", strip_spaces("pan").alias("pan_clean"),
                    mask_pan(strip_spaces("pan")).alias("maskedPan"))


_LABELS = ("concat_ws(', ', "
           f"CASE WHEN {_BLANK.format(c='merchantId')} THEN 'merchantId' END, "
           f"CASE WHEN {_BLANK.format(c=_PAN)} OR length({_PAN}) < 12 THEN 'pan (12+ digits)' END, "
           f"CASE WHEN {_BLANK.format(c='amount')} THEN 'amount' END, "
           f"CASE WHEN {_BLANK.format(c='currency')} THEN 'currency' END)")
_AMOUNT = ("CASE WHEN NOT regexp_matches(amount, '^\\s|\\s$') "
           "AND TRY_CAST(amount AS DECIMAL(18,2)) = TRY_CAST(amount AS DECIMAL(38,18)) "
           "THEN TRY_CAST(amount AS DECIMAL(18,2)) END")


@query("validate_requests", Q.with_(Q.REQ, Q.RAW) + f"""
SELECT request_id,
       coalesce(CASE WHEN labels <> '' THEN 'Missing/invalid fields: ' || labels END,
                CASE WHEN amt IS NULL THEN 'Invalid amount: ' || amount END) AS error
FROM (SELECT *, {_LABELS} AS labels, {_AMOUNT} AS amt FROM raw) x""")
def q_validate(p: Pipeline) -> DataFrame:
    return A.request_errors(p.raw_requests)


@query("parse_amount", Q.with_(Q.REQ, Q.RAW) + f"""
SELECT request_id, amount AS amount_text, {_AMOUNT} AS amount FROM raw""")
def q_parse_amount(p: Pipeline) -> DataFrame:
    r = p.raw_requests
    return r.select("request_id", F.col("amount").alias("amount_text"),
                    parse_amount("amount").alias("amount"))


@query("default_keys", Q.with_(Q.REQ, Q.RAW) + f"""
SELECT request_id,
       CASE WHEN {_BLANK.format(c='idempotencyKey')}
            THEN 'gen-' || sha256(CAST(request_id AS VARCHAR)) ELSE idempotencyKey END AS idempotencyKey
FROM raw""")
def q_default_keys(p: Pipeline) -> DataFrame:
    from cardflow.functions.requests import default_key
    return p.raw_requests.select("request_id", default_key("idempotencyKey", "request_id")
                                 .alias("idempotencyKey"))


# ---------------------------------------------------------------------------
# authorization: D1-D3, J1, J2, S4, K1
# ---------------------------------------------------------------------------


@query("authorize_outcomes", Q.with_(Q.REQ, Q.ATT, Q.LED) + """
SELECT a.request_id,
       CASE WHEN a.rn = 1 THEN 'APPROVED' ELSE 'DUPLICATE' END AS outcome,
       l.transactionId, l.amount,
       CASE WHEN a.rn = 1 THEN 'receipts/' || l.merchantId || '/' || l.transactionId || '.json' END AS receiptKey
FROM att a JOIN led l ON a.idempotencyKey = l.idempotencyKey""")
def q_outcomes(p: Pipeline) -> DataFrame:
    return p.outcomes_plan.select("request_id", "outcome", "transactionId", "amount", "receiptKey")


@query("authorizations", Q.BASE + """
SELECT idempotencyKey, transactionId, merchantId, maskedPan, encryptedPan, amount, currency, status, createdAt
FROM led""")
def q_authorizations(p: Pipeline) -> DataFrame:
    return A.new_rows(p.outcomes_plan)


@query("authorizations_encrypted", Q.with_(Q.REQ, Q.ATT, Q.LED) + """
SELECT l.idempotencyKey, l.maskedPan, a.pan FROM led l JOIN att a ON l.request_id = a.request_id""")
def q_encrypted(p: Pipeline) -> DataFrame:
    """The ledger with encrypted card numbers, decrypted again."""
    from cardflow.functions.pan import decrypt_pan
    from cardflow.sources.fixtures import FIXTURE_PAN_KEY
    key = F.lit(FIXTURE_PAN_KEY)
    return A.new_rows(A.authorize(p.valid, key=key)).select(
        "idempotencyKey", "maskedPan", decrypt_pan("encryptedPan", key).alias("pan"))


@query("duplicates_by_merchant", Q.with_(Q.REQ, Q.ATT, Q.LED) + """
SELECT l.merchantId, count(*) FILTER (WHERE a.rn = 1) AS approved, count(*) FILTER (WHERE a.rn > 1) AS duplicates
FROM att a JOIN led l ON a.idempotencyKey = l.idempotencyKey GROUP BY l.merchantId""")
def q_dups(p: Pipeline) -> DataFrame:
    return A.duplicates_by_merchant(p.outcomes_plan)


_AM = "hour(arrival) < 12"


@query("anti_join_new_keys", Q.with_(Q.REQ) + f""",
am AS (SELECT * FROM req WHERE {_AM}),
pm AS (SELECT * FROM req WHERE NOT ({_AM})),
am_keys AS (SELECT DISTINCT idempotencyKey FROM am),
pm_rank AS (SELECT *, row_number() OVER (PARTITION BY idempotencyKey ORDER BY arrival, request_id) AS rn FROM pm)
SELECT request_id,
       CASE WHEN rn = 1 AND NOT EXISTS (SELECT 1 FROM am_keys k WHERE k.idempotencyKey = pm_rank.idempotencyKey)
            THEN 'APPROVED' ELSE 'DUPLICATE' END AS outcome
FROM pm_rank""")
def q_anti_join(p: Pipeline) -> DataFrame:
    am = p.valid.where(F.hour("arrival") < 12)
    pm = p.valid.where(~(F.hour("arrival") < 12))
    ledger = A.new_rows(A.authorize(am))
    return A.authorize(pm, ledger=ledger).select("request_id", "outcome")


@query("point_lookup", Q.with_(Q.REQ, Q.ATT, Q.LED) + """,
am AS (SELECT * FROM led WHERE hour(createdAt) < 12),
keys AS (SELECT DISTINCT idempotencyKey FROM req)
SELECT k.idempotencyKey, am.transactionId IS NOT NULL AS found, am.transactionId, am.amount
FROM keys k LEFT JOIN am ON k.idempotencyKey = am.idempotencyKey""")
def q_point_lookup(p: Pipeline) -> DataFrame:
    am = p.stored.where(F.hour("createdAt") < 12)
    keys = p.requests.select("idempotencyKey").distinct()
    return L.find_by_key(am, keys).select("idempotencyKey", "found", "transactionId", "amount")


# ---------------------------------------------------------------------------
# scoring and alerts: P8-P10, K6
# ---------------------------------------------------------------------------


@query("fraud_scores", Q.BASE_SC + """
SELECT transactionId, riskScore, alerted, scored_at FROM sc""")
def q_scores(p: Pipeline) -> DataFrame:
    return p.scored.select("transactionId", "riskScore", "alerted", "scored_at")


@query("fraud_alerts", Q.BASE_SC + """
SELECT transactionId, merchantId, maskedPan, amount, riskScore,
       'High-risk transaction flagged' AS subject,
       CASE WHEN riskScore > 0.85 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
       printf('{"transactionId":"%s","merchantId":"%s","maskedPan":"%s","amount":%s,"riskScore":%.2f}',
              transactionId, merchantId, maskedPan, CAST(amount AS VARCHAR), riskScore) AS message
FROM sc WHERE alerted""")
def q_alerts(p: Pipeline) -> DataFrame:
    return p.alerts


@query("severity_counts", Q.BASE_SC + """
SELECT CASE WHEN riskScore > 0.85 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, count(*) AS alerts
FROM sc WHERE alerted GROUP BY 1""")
def q_severity(p: Pipeline) -> DataFrame:
    return severity_counts(p.alerts)


# ---------------------------------------------------------------------------
# lifecycle: L1-L5, S5
# ---------------------------------------------------------------------------


@query("current_status", Q.BASE_EV + ", " + Q.fold(CUT) + """
SELECT idempotencyKey, cur_status AS status FROM cur""")
def q_current_status(p: Pipeline) -> DataFrame:
    return p.current(CUTOFF).select("idempotencyKey", "status")


@query("status_query_held", Q.BASE_EV + ", " + Q.fold(CUT) + """
SELECT idempotencyKey, transactionId, createdAt, row_number() OVER (ORDER BY createdAt, idempotencyKey) AS rank
FROM cur WHERE cur_status = 'HELD_FOR_REVIEW'""")
def q_status_query(p: Pipeline) -> DataFrame:
    """The held rows, oldest first (their position as a column)."""
    held = L.find_by_status(p.current(CUTOFF), "HELD_FOR_REVIEW")
    return numbered(held.select("idempotencyKey", "transactionId", "createdAt"), ["createdAt", "idempotencyKey"])


@query("status_update_keys", Q.BASE + """,
asked AS (SELECT CASE WHEN request_id % 3 = 0 THEN 'no-' || idempotencyKey ELSE idempotencyKey END AS idempotencyKey,
                 createdAt + INTERVAL '1' DAY AS event_ts FROM led WHERE request_id % 5 = 0)
SELECT a.idempotencyKey, a.event_ts, l.idempotencyKey IS NOT NULL AS found,
       CASE WHEN l.idempotencyKey IS NOT NULL THEN 'HELD_FOR_REVIEW' END AS status
FROM asked a LEFT JOIN led l ON a.idempotencyKey = l.idempotencyKey""")
def q_status_update(p: Pipeline) -> DataFrame:
    """L1: an update by key; every third key asked for does not exist."""
    asked = p.approved.where(F.col("request_id") % 5 == 0).select(
        F.when(F.col("request_id") % 3 == 0, F.concat(F.lit("no-"), F.col("idempotencyKey")))
        .otherwise(F.col("idempotencyKey")).alias("idempotencyKey"),
        (F.col("arrival") + F.expr("INTERVAL 1 DAY")).alias("event_ts"))
    ev, missing = L.status_update(p.stored, asked, "HELD_FOR_REVIEW")
    return (ev.select("idempotencyKey", "event_ts", F.lit(True).alias("found"), "status")
            .unionByName(missing.select("idempotencyKey", "event_ts", F.lit(False).alias("found"),
                                        F.lit(None).cast("string").alias("status"))))


@query("release_requests", Q.with_(Q.REQ, Q.ATT, Q.LED, Q.SCORES) + """,
rel AS (SELECT transactionId, arrival + INTERVAL '2' DAY AS released_at FROM sc WHERE alerted AND request_id % 10 = 0)
SELECT r.transactionId, r.released_at, l.idempotencyKey,
       l.idempotencyKey IS NOT NULL AS found
FROM rel r LEFT JOIN led l ON r.transactionId = l.transactionId AND l.createdAt <= r.released_at""")
def q_release(p: Pipeline) -> DataFrame:
    ev, nf = p.release
    found = ev.select("idempotencyKey", F.col("event_ts").alias("released_at"))
    rel = p.release_requests
    keys = p.stored.select("idempotencyKey", "transactionId")
    f = found.join(keys, "idempotencyKey").select("transactionId", "released_at", "idempotencyKey",
                                                  F.lit(True).alias("found"))
    n = nf.select("transactionId", "released_at", F.lit(None).cast("string").alias("idempotencyKey"),
                  F.lit(False).alias("found"))
    return f.unionByName(n)


@query("release_unknown_and_early", Q.with_(Q.REQ, Q.ATT, Q.LED) + """,
rel AS (SELECT CASE WHEN request_id % 4 = 0 THEN 'x' || transactionId ELSE transactionId END AS transactionId,
               CASE WHEN request_id % 4 = 1 THEN arrival - INTERVAL '1' DAY ELSE arrival END AS released_at
        FROM led WHERE request_id % 2 = 0 OR request_id % 4 = 1)
SELECT r.transactionId, r.released_at, l.idempotencyKey, l.idempotencyKey IS NOT NULL AS found
FROM rel r LEFT JOIN led l ON r.transactionId = l.transactionId AND l.createdAt <= r.released_at""")
def q_release_missing(p: Pipeline) -> DataFrame:
    """L4: releases of unknown transactions, before the first entry, and at
    the very moment of it."""
    rid = F.col("request_id")
    asked = p.approved.where((rid % 2 == 0) | (rid % 4 == 1)).select(
        F.when(rid % 4 == 0, F.concat(F.lit("x"), F.col("transactionId"))).otherwise(F.col("transactionId"))
        .alias("transactionId"),
        F.when(rid % 4 == 1, F.col("arrival") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("arrival")).alias("released_at"))
    ev, missing = L.release(asked, p.outcomes)
    keys = p.stored.select("idempotencyKey", "transactionId")
    return (ev.select("idempotencyKey", F.col("event_ts").alias("released_at")).join(keys, "idempotencyKey")
            .select("transactionId", "released_at", "idempotencyKey", F.lit(True).alias("found"))
            .unionByName(missing.select("transactionId", "released_at", F.lit(None).cast("string").alias("idempotencyKey"),
                                        F.lit(False).alias("found"))))


# ---------------------------------------------------------------------------
# settlement: L3, A1, A2, K3, K7
# ---------------------------------------------------------------------------

_B1 = Q.BASE_EV + ", " + Q.fold(CUT1)


@query("settlement_totals", _B1 + """
SELECT count(*) AS transactionCount, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS totalAmount
FROM cur WHERE cur_status = 'AUTHORIZED'""")
def q_totals(p: Pipeline) -> DataFrame:
    return S.totals(p.batch1_current)


@query("settlement_by_currency", _B1 + """
SELECT currency, count(*) AS transactionCount, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS totalAmount
FROM cur WHERE cur_status = 'AUTHORIZED' GROUP BY currency""")
def q_by_currency(p: Pipeline) -> DataFrame:
    return S.totals(p.batch1_current, by_currency=True)


@query("settlement_ids", _B1 + f"""
SELECT '{BATCH_1}' AS batchId, transactionId, createdAt, row_number() OVER (ORDER BY createdAt, idempotencyKey) AS rank
FROM cur WHERE cur_status = 'AUTHORIZED'""")
def q_ids(p: Pipeline) -> DataFrame:
    """A2: the settled ids, oldest first (their position as a column)."""
    return numbered(S.settled_ids(p.batch1_current, BATCH_1), ["createdAt", "idempotencyKey"]).select(
        "batchId", "transactionId", "createdAt", "rank")


@query("batch_ids", Q.BASE + """
SELECT merchantId, CAST(createdAt AS DATE) AS day, count(*) AS transactions,
       'batch-' || CAST(epoch_ms(CAST(CAST(createdAt AS DATE) AS TIMESTAMP)) AS VARCHAR) || '-'
       || substr(sha256(merchantId), 1, 8) AS batchId,
       'settlements/batch-' || CAST(epoch_ms(CAST(CAST(createdAt AS DATE) AS TIMESTAMP)) AS VARCHAR) || '-'
       || substr(sha256(merchantId), 1, 8) || '.json' AS summaryKey
FROM led GROUP BY merchantId, CAST(createdAt AS DATE)""")
def q_batch_ids(p: Pipeline) -> DataFrame:
    """Batch ids and summary keys computed as columns, a batch for
    every merchant and day."""
    from cardflow.functions.text import batch_id_col, summary_key
    d = p.stored.groupBy("merchantId", F.col("createdAt").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("transactions"))
    d = d.withColumn("batchId", batch_id_col(F.col("day").cast("timestamp_ntz"), F.col("merchantId")))
    return d.withColumn("summaryKey", summary_key("batchId"))


@query("settlement_notice", _B1 + f"""
SELECT '{BATCH_1}' AS batchId, TIMESTAMP '{CUT1}' AS settledAt, count(*) AS transactionCount,
       CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS totalAmount,
       'settlements/{BATCH_1}.json' AS batchSummaryKey,
       'Settlement batch complete: {BATCH_1}' AS subject,
       printf('Settled %d transaction(s) totaling %s', count(*),
              CASE WHEN count(*) = 0 THEN '0' ELSE CAST(CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS VARCHAR) END) AS message
FROM cur WHERE cur_status = 'AUTHORIZED'""")
def q_notice(p: Pipeline) -> DataFrame:
    return S.summary(p.batch1_current, BATCH_1, FIRST_CUTOFF)


@query("settlement_document", _B1 + f"""
SELECT '{BATCH_1}' AS batchId, strftime(TIMESTAMP '{CUT1}', '%Y-%m-%dT%H:%M:%SZ') AS settledAt,
       count(*) AS transactionCount,
       CASE WHEN count(*) = 0 THEN '0' ELSE CAST(CAST(sum(amount) AS DECIMAL(38,2)) AS VARCHAR) END AS totalAmount,
       'settlements/{BATCH_1}/ids' AS transactionIdsPath, count(*) AS transactionIdsCount
FROM cur WHERE cur_status = 'AUTHORIZED'""")
def q_document(p: Pipeline) -> DataFrame:
    """K3: the summary document, one schema at any number of ids."""
    return S.summary_document(p.batch1_current, BATCH_1, FIRST_CUTOFF, f"settlements/{BATCH_1}/ids")


_SETTLE1 = f"SELECT idempotencyKey, 'SETTLED', TIMESTAMP '{CUT1}', 3 FROM cur1 WHERE cur_status = 'AUTHORIZED'"


@query("settlement_empty", Q.BASE_EV + ", " + Q.fold(CUT1).replace("cur AS", "cur1 AS", 1) + ", " +
       Q.fold(CUT1, _SETTLE1) + f"""
SELECT '{EMPTY_BATCH}' AS batchId, count(*) AS transactionCount,
       CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS totalAmount,
       printf('Settled %d transaction(s) totaling %s', count(*),
              CASE WHEN count(*) = 0 THEN '0' ELSE CAST(CAST(sum(amount) AS DECIMAL(38,2)) AS VARCHAR) END) AS message
FROM cur WHERE cur_status = 'AUTHORIZED'""")
def q_empty(p: Pipeline) -> DataFrame:
    """A second run at the same cutoff: everything AUTHORIZED was just settled."""
    cur = p.current(FIRST_CUTOFF, p.events_after_batch1)
    return S.summary(cur, EMPTY_BATCH, FIRST_CUTOFF).select(
        "batchId", "transactionCount", "totalAmount", "message")


@query("settlement_second_batch", Q.BASE_EV + ", " + Q.fold(CUT1).replace("cur AS", "cur1 AS", 1) + ", " +
       Q.fold(CUT, _SETTLE1) + """
SELECT count(*) AS transactionCount, CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS totalAmount
FROM cur WHERE cur_status = 'AUTHORIZED'""")
def q_second(p: Pipeline) -> DataFrame:
    return S.totals(p.batch2_current)




# ---------------------------------------------------------------------------
# feed: T1-T6, J3, J4, S7, P15-P18, A4
# ---------------------------------------------------------------------------

_SETTLE2 = f"SELECT idempotencyKey, 'SETTLED', TIMESTAMP '{CUT}', 3 FROM cur2 WHERE cur_status = 'AUTHORIZED'"
_FEED_BASE = (Q.BASE_EV + ", " + Q.fold(CUT1).replace("cur AS", "cur1 AS", 1) + ", "
              + Q.fold(CUT, _SETTLE1).replace("cur AS", "cur2 AS", 1) + ",\n"
              + f"evall AS (SELECT * FROM ev UNION ALL {_SETTLE1} UNION ALL {_SETTLE2}),\n"
              + Q.REL + ",\n" + Q.ENTRIES + ",\n" + Q.entries0("evall"))
_ACTS_SCORE = """acts AS (
  SELECT transactionId, scored_at AS action_ts, 'score' AS kind, riskScore, alerted, 1 AS seq FROM sc)"""
_ACTS_ALL = f"""acts AS (
  SELECT transactionId, scored_at AS action_ts, 'score' AS kind, riskScore, alerted, 1 AS seq FROM sc
  UNION ALL SELECT transactionId, released_at, 'release', NULL, NULL, 2 FROM rel
  UNION ALL SELECT transactionId, TIMESTAMP '{CUT1}', 'settle', NULL, NULL, 3 FROM cur1 WHERE cur_status = 'AUTHORIZED'
  UNION ALL SELECT transactionId, TIMESTAMP '{CUT}', 'settle', NULL, NULL, 3 FROM cur2 WHERE cur_status = 'AUTHORIZED')"""
_FEED_SCORES = ",\n".join([_FEED_BASE, _ACTS_SCORE, Q.TARGETS, Q.STATE, Q.FEED]) + "\n"
_FEED_ALL = ",\n".join([_FEED_BASE, _ACTS_ALL, Q.TARGETS, Q.STATE, Q.FEED]) + "\n"
_FEED_COLS = ("request_id, arrival, transactionId, idempotencyKey, merchantId, maskedPan, amount, currency, "
              "status, stage, riskScore, receiptKey, updatedAt")


@query("feed_asof_scores", _FEED_SCORES + """
SELECT request_id, transactionId, riskScore, stage, status FROM feed""")
def q_feed_scores(p: Pipeline) -> DataFrame:
    f = FD.apply_actions(p.entries, FD.score_actions(p.scored))
    return f.select("request_id", "transactionId", "riskScore", "stage", "status")


@query("feed_actions", _FEED_ALL + f"""
SELECT {_FEED_COLS} FROM feed""")
def q_feed_actions(p: Pipeline) -> DataFrame:
    return p.feed


@query("feed_recent_100", _FEED_ALL + f"""
SELECT {_FEED_COLS} FROM feed ORDER BY arrival DESC, request_id DESC LIMIT 100""")
def q_feed_recent(p: Pipeline) -> DataFrame:
    return FD.recent(p.feed, 100)


@query("feed_display", _FEED_ALL + """,
top AS (SELECT * FROM feed ORDER BY arrival DESC, request_id DESC LIMIT 100)
SELECT request_id, transactionId, substr(transactionId, 1, 8) || '…' AS shortId, merchantId, maskedPan,
       concat_ws(' ', amount, currency) AS amountLabel, lower(stage) AS stageLabel,
       CAST(CASE stage WHEN 'RECORDED' THEN 0 WHEN 'QUEUED' THEN 1 WHEN 'SCORED' THEN 2
                       WHEN 'ALERTED' THEN 3 WHEN 'SETTLED' THEN 4 ELSE -1 END AS INTEGER) AS stageRank,
       CAST(round(riskScore * 100) AS BIGINT) AS riskPercent,
       coalesce(CAST(CAST(round(riskScore * 100) AS BIGINT) AS VARCHAR) || '%', 'pending…') AS riskLabel,
       coalesce(riskScore > 0.75, false) AS riskHigh,
       CASE WHEN coalesce(receiptKey, '') <> '' THEN regexp_extract(receiptKey, '[^/]*$') END AS receiptName,
       coalesce(receiptKey, '') AS receiptKey,
       CASE WHEN status = 'DUPLICATE' THEN 'status-duplicate' WHEN stage = 'ALERTED' THEN 'status-alerted'
            ELSE 'status-approved' END AS rowClass,
       coalesce(stage = 'ALERTED', false) AS canRelease
FROM top""")
def q_feed_display(p: Pipeline) -> DataFrame:
    return FD.display(FD.recent(p.feed, 100))


@query("feed_ticker", _FEED_ALL + """,
newest AS (SELECT stage FROM feed ORDER BY arrival DESC, request_id DESC LIMIT 1),
stages AS (SELECT * FROM (VALUES ('RECORDED', 0), ('QUEUED', 1), ('SCORED', 2), ('ALERTED', 3), ('SETTLED', 4)) t(stage, pos))
SELECT s.stage,
       s.pos <= CASE n.stage WHEN 'RECORDED' THEN 0 WHEN 'QUEUED' THEN 1 WHEN 'SCORED' THEN 2
                             WHEN 'ALERTED' THEN 3 WHEN 'SETTLED' THEN 4 ELSE -1 END AS lit,
       s.stage = n.stage AND n.stage = 'ALERTED' AS alert
FROM stages s, newest n""")
def q_feed_ticker(p: Pipeline) -> DataFrame:
    return FD.ticker(p.feed)


@query("feed_newest_entry", _FEED_ALL + """,
newest AS (SELECT transactionId, first(request_id ORDER BY arrival DESC, request_id DESC) AS request_id
           FROM feed GROUP BY transactionId)
SELECT r.transactionId, n.request_id, n.request_id IS NOT NULL AS found
FROM rel r LEFT JOIN newest n ON r.transactionId = n.transactionId""")
def q_newest_entry(p: Pipeline) -> DataFrame:
    return FD.newest_entry(p.feed, p.release_requests.select("transactionId"))


# ---------------------------------------------------------------------------
# velocity: A3, F2, W1, W2, W8
# ---------------------------------------------------------------------------

from cardflow.operators import velocity as V  # noqa: E402
from cardflow.sinks.messages import topic_partition  # noqa: E402

_CARD = "'**** **** **** ' || right(pan, 4)"
_FIVE = "CAST(CAST(right(pan, 2) AS INTEGER) % 5 AS VARCHAR)"


def _card_events(p: Pipeline, key: str = "card") -> DataFrame:
    r = p.requests
    k = (mask_pan("pan") if key == "card"
         else (F.substring("pan", -2, 2).cast("int") % 5).cast("string"))
    return r.select(F.col("request_id").alias("id"), k.alias("key"), F.col("arrival").alias("ts"))


def _tumbling_sql(width: str, key: str, having: bool = True) -> str:
    return Q.with_(Q.REQ) + f"""
SELECT time_bucket(INTERVAL '{width}', arrival) AS window_start,
       time_bucket(INTERVAL '{width}', arrival) + INTERVAL '{width}' AS window_end,
       {key} AS key, count(*) AS count
FROM req GROUP BY ALL {'HAVING count(*) >= 3' if having else ''}"""


@query("velocity_window_counts_30s", _tumbling_sql("30 seconds", _CARD, having=False))
def q_vel_counts(p: Pipeline) -> DataFrame:
    """A3 with the reference's 30 s windows: every (window, card) count."""
    return V.window_counts(_card_events(p), size="30 seconds")


@query("velocity_tumbling", _tumbling_sql("1 day", _CARD))
def q_vel_tumbling(p: Pipeline) -> DataFrame:
    """W1 at the scaled window (1 day by card, threshold 3)."""
    return V.velocity_tumbling(_card_events(p), size="1 day")


@query("velocity_tumbling_hourly", _tumbling_sql("1 hour", _CARD))
def q_vel_hourly(p: Pipeline) -> DataFrame:
    return V.velocity_tumbling(_card_events(p), size="1 hour")


@query("velocity_ten_min_five_keys", _tumbling_sql("10 minutes", _FIVE))
def q_vel_five(p: Pipeline) -> DataFrame:
    return V.velocity_tumbling(_card_events(p, "five"), size="10 minutes")


@query("velocity_trailing", Q.with_(Q.REQ) + f"""
SELECT request_id AS id, key, arrival AS ts, trailing_count FROM (
  SELECT request_id, {_CARD} AS key, arrival,
         count(*) OVER (PARTITION BY {_CARD} ORDER BY arrival
                        RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS trailing_count
  FROM req) x
WHERE trailing_count >= 3""")
def q_vel_trailing(p: Pipeline) -> DataFrame:
    """Records with 3+ of the same card in the trailing day."""
    return V.velocity_trailing(_card_events(p), size="1 day")


@query("velocity_trailing_stream", Q.with_(Q.REQ) + f""",
rec AS (SELECT request_id, arrival, {_CARD} AS key,
               CAST('0x' || substr(md5({_CARD}), 1, 8) AS BIGINT) % 4 AS part FROM req)
SELECT CAST(part AS INTEGER) AS source_partition, id, key, arrival AS ts, trailing_count FROM (
  SELECT part, key, arrival,
         row_number() OVER (PARTITION BY part ORDER BY arrival, key, CAST(request_id AS VARCHAR)) - 1 AS id,
         count(*) OVER (PARTITION BY key ORDER BY arrival
                        RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS trailing_count
  FROM rec) x
WHERE trailing_count >= 3""")
def q_vel_trailing_stream(p: Pipeline) -> DataFrame:
    """The trailing check as a stream-stream join over a
    topic published in three batches, the query restarted after each."""
    from cardflow.plans.streams import trailing_stream
    return trailing_stream(p.spark, p.requests, "1 day", "1 hour")


@query("velocity_tumbling_stream", _tumbling_sql("1 day", _CARD))
def q_vel_tumbling_stream(p: Pipeline) -> DataFrame:
    """The tumbling check as a stream in update mode."""
    from cardflow.plans.streams import tumbling_stream
    return tumbling_stream(p.spark, p.requests, "1 day", "1 hour")


@query("authorizer_stream", Q.with_(Q.REQ, Q.ATT, Q.LED) + """
SELECT a.request_id, CASE WHEN a.rn = 1 THEN 'APPROVED' ELSE 'DUPLICATE' END AS outcome, l.transactionId, l.amount
FROM att a JOIN led l ON a.idempotencyKey = l.idempotencyKey""")
def q_authorizer_stream(p: Pipeline) -> DataFrame:
    """Requests landed as JSON, authorized as a stream."""
    from cardflow.plans.streams import authorizer_stream
    return authorizer_stream(p.spark, p.requests).select("request_id", "outcome", "transactionId", "amount")


@query("scoring_stream", Q.BASE_SC + f"""
SELECT 'score' AS kind, transactionId AS what, riskScore, alerted, CAST(NULL AS INTEGER) AS receives FROM sc
UNION ALL
SELECT 'dead', substr({Q.JSON_BODY}, 1, 60), NULL, NULL, 2 FROM led WHERE transactionId LIKE '0%'""")
def q_scoring_stream(p: Pipeline) -> DataFrame:
    """Messages scored as a stream, half messages received
    twice before they are dead letters."""
    from cardflow.plans.streams import scoring_stream
    return scoring_stream(p.spark, p.stored, 2)


def _topic(p: Pipeline) -> DataFrame:
    """Scored transactions as topic records: event time = createdAt,
    replay order = scoring time (each arrives one to five hours late,
    or a second early)."""
    s = p.scored
    return s.select(F.col("request_id").alias("id"), F.col("maskedPan").alias("key"),
                    F.col("arrival").alias("ts"), F.col("scored_at").alias("arrival"),
                    topic_partition(F.col("maskedPan")).alias("source_partition"))


_PART = "CAST('0x' || substr(md5({c}), 1, 8) AS BIGINT) % 4"


@query("velocity_exact_late", Q.BASE_SC + f""",
rec AS (SELECT request_id, maskedPan AS key, arrival AS ts, scored_at,
               {_PART.format(c='maskedPan')} AS part FROM sc),
seen AS (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY part ORDER BY scored_at, request_id
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_us,
                time_bucket(INTERVAL '1 hour', ts) AS window_start FROM rec)
SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, key,
       count(*) FILTER (WHERE NOT late) AS admitted, count(*) FILTER (WHERE late) AS late
FROM (SELECT *, epoch_us(window_start) + 3600000000 <= seen_us - 5000000 AS late FROM seen) x
GROUP BY ALL""")
def q_vel_exact(p: Pipeline) -> DataFrame:
    """Exact per-record lateness (1 h windows, 5 s grace) over the
    scored-transaction topic, per partition in replay order."""
    m = V.drop_late(_topic(p), size="1 hour", grace="5 seconds")
    return (m.groupBy("window_start", "window_end", "key")
            .agg(F.count(F.when(~F.col("late"), 1)).alias("admitted"),
                 F.count(F.when(F.col("late"), 1)).alias("late")))


# ---------------------------------------------------------------------------
# planning: C1-C4
# ---------------------------------------------------------------------------

from cardflow.operators import planning as PL  # noqa: E402
from cardflow.constants import STORAGE_GROWTH_PCT, STORAGE_YEARS  # noqa: E402

_LAT = "(epoch_us(scored_at) - epoch_us(arrival)) / 1000.0"
_CONC = Q.BASE_SC + f""",
conc AS (SELECT time_bucket(INTERVAL '1 hour', arrival) AS bucket, count(*) AS arrivals,
                count(*) / 3600.0 AS throughput,
                avg(CASE WHEN {_LAT} >= 0 THEN {_LAT} END) AS latency_ms,
                count(*) / 3600.0 * (avg(CASE WHEN {_LAT} >= 0 THEN {_LAT} END) / 1000.0) AS concurrency
         FROM sc GROUP BY 1)"""


@query("concurrency_by_hour", _CONC + """
SELECT bucket, arrivals, throughput, latency_ms, concurrency FROM conc""")
def q_concurrency(p: Pipeline) -> DataFrame:
    return PL.concurrency(p.scored, "1 hour")


@query("instances_by_model", _CONC + """,
models AS (SELECT * FROM (VALUES (0, 'Blocking — platform threads', 50),
                                 (1, 'Blocking — virtual threads', 512),
                                 (2, 'Non-blocking / async', 512)) t(model_rank, model, capacity)),
x AS (SELECT c.bucket, m.model_rank, m.model, m.capacity,
             CAST(ceil(c.concurrency / m.capacity) AS BIGINT) AS raw,
             CAST(ceil(CAST(ceil(c.concurrency / m.capacity) AS BIGINT) * 1.25) AS BIGINT) AS with_buffer,
             CAST(ceil(CAST(ceil(c.concurrency / 50.0) AS BIGINT) * 1.25) AS BIGINT) AS base
      FROM conc c CROSS JOIN models m)
SELECT bucket, model_rank, model, capacity, raw, with_buffer,
       CAST(CASE WHEN base > 0 THEN round((1 - with_buffer / base) * 100) ELSE 0 END AS BIGINT) AS reduction_pct,
       CASE WHEN with_buffer > 0 THEN round(base / with_buffer, 1) END AS ratio
FROM x""")
def q_instances(p: Pipeline) -> DataFrame:
    return PL.instances(PL.concurrency(p.scored, "1 hour"))


def _daily(p: Pipeline) -> DataFrame:
    from cardflow.functions.text import encode_json
    rows = p.stored.select("merchantId", "createdAt", F.length(encode_json()).alias("bytes"))
    return PL.daily_volume(rows, "createdAt", "bytes")


_FACTOR = repr(sum((1 + STORAGE_GROWTH_PCT / 100.0) ** y for y in range(STORAGE_YEARS)))
_PROJ = Q.BASE + f""",
d AS (SELECT merchantId, CAST(createdAt AS DATE) AS day, count(*) AS n, sum(length({Q.JSON_BODY})) AS bytes
      FROM led GROUP BY ALL),
dv AS (SELECT merchantId, sum(n) / count(*) AS daily_items, sum(bytes) / sum(n) / 1024.0 AS item_kb
       FROM d GROUP BY merchantId),
pr AS (SELECT merchantId, daily_items, item_kb, daily_items * 365.0 * {_FACTOR} AS total_items,
              daily_items * 365.0 * {_FACTOR} * item_kb / 1048576.0 AS raw_gb,
              daily_items * 365.0 * {_FACTOR} * item_kb / 1048576.0 * 2.0 AS total_gb
       FROM dv)"""


@query("storage_projection", _PROJ + """
SELECT merchantId, daily_items, item_kb, total_items, raw_gb, total_gb,
       CASE WHEN total_gb >= 1048576.0 THEN printf('%.2f PB', total_gb / 1048576.0)
            WHEN total_gb >= 1024.0 THEN printf('%.2f TB', total_gb / 1024.0)
            ELSE printf('%.2f GB', total_gb) END AS total_label
FROM pr""")
def q_storage(p: Pipeline) -> DataFrame:
    return PL.storage_projection(_daily(p))


@query("tier_costs", _PROJ + """,
tiers AS (SELECT * FROM (VALUES (0, 'hot', 0.25::DOUBLE), (1, 'warm', 0.023::DOUBLE),
                                (2, 'cold', 0.00099::DOUBLE)) t(tier_rank, tier, price_gb_month))
SELECT merchantId, total_gb, tier_rank, tier, price_gb_month, total_gb * price_gb_month AS monthly_cost,
       CASE WHEN tier_rank = 0 THEN NULL
            ELSE CAST(round((1 - (total_gb * price_gb_month) / (total_gb * 0.25)) * 100) AS BIGINT) END AS saving_pct,
       CASE WHEN total_gb * price_gb_month >= 1000 THEN '$' || format('{:,.0f}', total_gb * price_gb_month)
            ELSE printf('$%.2f', total_gb * price_gb_month) END AS cost_label
FROM pr CROSS JOIN tiers""")
def q_tiers(p: Pipeline) -> DataFrame:
    return PL.tier_costs(PL.storage_projection(_daily(p)))


# ---------------------------------------------------------------------------
# wire format and card numbers: P2, P3, P14, K4, K5
# ---------------------------------------------------------------------------


@query("fraud_messages", Q.BASE + f"""
SELECT transactionId, {Q.JSON_BODY} AS body, amount FROM led""")
def q_messages(p: Pipeline) -> DataFrame:
    from cardflow.sinks.messages import fraud_messages
    return fraud_messages(p.stored).select("transactionId", "body", "amount")


@query("topic_records", Q.BASE + f"""
SELECT maskedPan AS key, {Q.JSON_BODY} AS value, createdAt AS timestamp,
       CAST({_PART.format(c='maskedPan')} AS INTEGER) AS source_partition
FROM led""")
def q_topic(p: Pipeline) -> DataFrame:
    from cardflow.sinks.messages import topic_records
    return topic_records(p.stored).select("key", "value", "timestamp", "source_partition")


@query("message_round_trip", Q.BASE + """
SELECT idempotencyKey, transactionId, merchantId, maskedPan, encryptedPan, amount, currency, status, createdAt
FROM led""")
def q_msg_round_trip(p: Pipeline) -> DataFrame:
    """Encode every stored row as its message body and decode it back."""
    from cardflow.functions.text import encode_json, with_decoded
    return with_decoded(p.stored.select(encode_json().alias("body")), "body").select("t.*")


@query("receipt_round_trip", Q.BASE + """
SELECT 'receipts/' || merchantId || '/' || transactionId || '.json' AS receiptKey, idempotencyKey, maskedPan, amount,
       createdAt, true AS in_indexed_file
FROM led""")
def q_receipt_round_trip(p: Pipeline) -> DataFrame:
    """Every receipt written, indexed and read back; its index entry
    names the file it lies in."""
    from cardflow.functions.text import receipt_key, with_decoded
    from cardflow.session import scratch_path
    from cardflow.sinks.writers import write_receipt_index, write_receipts
    base = scratch_path(p.spark, "receipts")
    write_receipts(p.stored, "", "", folder=f"{base}/documents")
    write_receipt_index(p.spark, f"{base}/documents/*", f"{base}/index")
    index = p.spark.read.parquet(f"{base}/index")
    raw = p.spark.read.schema("value string").text(f"{base}/documents/*").select("value", F.col("_metadata.file_path").alias("at"))
    rows = with_decoded(raw, "value").select("t.*", "at").withColumn("receiptKey", receipt_key("merchantId", "transactionId"))
    return rows.join(index, "receiptKey").select("receiptKey", "idempotencyKey", "maskedPan", "amount", "createdAt",
                                                 (F.col("at") == F.col("file")).alias("in_indexed_file"))


@query("pan_round_trip", Q.with_(Q.REQ) + """
SELECT request_id, '**** **** **** ' || right(pan, 4) AS maskedPan, true AS round_trip_ok,
       false AS context_mismatch_decrypts
FROM req""")
def q_pan_round_trip(p: Pipeline) -> DataFrame:
    """Every card number decrypts back to itself under the right
    context; under another context it does not decrypt."""
    from cardflow.functions.pan import decrypt_pan, encrypt_pan
    from cardflow.sources.fixtures import FIXTURE_PAN_KEY
    key = F.lit(FIXTURE_PAN_KEY)
    enc = p.requests.select("request_id", "pan", encrypt_pan("pan", key).alias("c"))
    return enc.select(
        "request_id", mask_pan("pan").alias("maskedPan"),
        (decrypt_pan("c", key) == F.col("pan")).alias("round_trip_ok"),
        decrypt_pan("c", key, context="purpose=other", lenient=True).isNotNull()
        .alias("context_mismatch_decrypts"))


# ---------------------------------------------------------------------------
# more lifecycle and validation views
# ---------------------------------------------------------------------------

_LABELS_STRICT = ("concat_ws(', ', "
                  f"CASE WHEN {_BLANK.format(c='merchantId')} THEN 'merchantId' END, "
                  f"CASE WHEN {_BLANK.format(c=_PAN)} OR length({_PAN}) < 12 OR length({_PAN}) > 19 "
                  "THEN 'pan (12+ digits)' END, "
                  f"CASE WHEN {_BLANK.format(c='amount')} OR NOT coalesce(regexp_full_match(amount, "
                  "'[0-9]+(\\.[0-9]{1,2})?'), false) THEN 'amount' END, "
                  f"CASE WHEN {_BLANK.format(c='currency')} OR NOT coalesce(currency IN ('USD', 'EUR', 'GBP'), false) "
                  "THEN 'currency' END)")


@query("validate_requests_strict", Q.with_(Q.REQ, Q.RAW) + f"""
SELECT request_id,
       coalesce(CASE WHEN labels <> '' THEN 'Missing/invalid fields: ' || labels END,
                CASE WHEN amt IS NULL THEN 'Invalid amount: ' || amount END) AS error
FROM (SELECT *, {_LABELS_STRICT} AS labels, {_AMOUNT} AS amt FROM raw) x""")
def q_validate_strict(p: Pipeline) -> DataFrame:
    """P5/P6 with the form-only rules: card at most 19 characters, amount
    with at most two decimals, currency from the form's list."""
    return A.request_errors(p.raw_requests, strict=True)


@query("lifecycle_final_status", _FEED_BASE + f""",
fin AS (SELECT idempotencyKey, arg_max(status, epoch_us(event_ts) * 10 + seq) AS status
        FROM evall WHERE event_ts <= TIMESTAMP '{CUT}' GROUP BY idempotencyKey)
SELECT status, count(*) AS transactions FROM fin GROUP BY status""")
def q_final_status(p: Pipeline) -> DataFrame:
    """Status of every stored transaction after both settlement batches."""
    return (L.current_status(p.all_events, CUTOFF)
            .groupBy("status").agg(F.count(F.lit(1)).alias("transactions")))


ORDERS_THRESHOLD = 250000
ORDERS_CUTOFF = "2002-01-01 00:00:00"  # after the last order date


@query("orders_settlement_by_priority", f"""
WITH o AS (SELECT o_orderpriority AS merchantId, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)
SELECT merchantId, count(*) AS authorized,
       count(*) FILTER (WHERE amount > {ORDERS_THRESHOLD}) AS held,
       count(*) FILTER (WHERE amount <= {ORDERS_THRESHOLD}) AS settled,
       CAST(coalesce(sum(amount) FILTER (WHERE amount <= {ORDERS_THRESHOLD}), 0) AS DECIMAL(38,2)) AS total
FROM o GROUP BY merchantId""")
def q_orders(p: Pipeline) -> DataFrame:
    """The minimum slice on ``orders`` as the ledger: every order is an
    authorization (key = order key), scored against a threshold of
    250,000, held above it, and the rest settled; per order priority."""
    from decimal import Decimal
    from cardflow.functions.scoring import default_score
    from cardflow.operators.scoring import score
    from cardflow.plans.context import slice_summary
    stored = p.orders_stored
    fn = lambda df: default_score(F.col("amount"), Decimal(ORDERS_THRESHOLD))
    scored = score(stored, fn).withColumn("scored_at", F.col("createdAt"))
    return slice_summary(stored, scored, ORDERS_CUTOFF)


# ---------------------------------------------------------------------------
# sink formats: receipts (K2), velocity alert lines (K8)
# ---------------------------------------------------------------------------


@query("receipt_documents", Q.BASE + f"""
SELECT 'receipts/' || merchantId || '/' || transactionId || '.json' AS receiptKey, merchantId,
       {Q.JSON_BODY} AS document
FROM led""")
def q_receipts(p: Pipeline) -> DataFrame:
    """K2: each stored transaction's receipt key and document."""
    from cardflow.functions.text import encode_json, receipt_key
    return p.stored.select(receipt_key("merchantId", "transactionId").alias("receiptKey"),
                           "merchantId", encode_json().alias("document"))


@query("velocity_alert_lines", Q.with_(Q.REQ) + f"""
SELECT window_start, key, count,
       printf('   >>> VELOCITY ALERT: card=%s count=%d window=[%s - %s]', key, count,
              strftime(window_start, '%Y-%m-%dT%H:%M:%SZ'), strftime(window_end, '%Y-%m-%dT%H:%M:%SZ')) AS message
FROM (SELECT time_bucket(INTERVAL '1 day', arrival) AS window_start,
             time_bucket(INTERVAL '1 day', arrival) + INTERVAL '1 day' AS window_end,
             {_CARD} AS key, count(*) AS count
      FROM req GROUP BY ALL HAVING count(*) >= 3) x""")
def q_alert_lines(p: Pipeline) -> DataFrame:
    """K8: the alert line of every 1-day window with 3+ requests of a card."""
    return V.alert_lines(V.velocity_tumbling(_card_events(p), size="1 day"))


# ---------------------------------------------------------------------------
# accessors
# ---------------------------------------------------------------------------


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query builder, by name."""
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for every registered query that has one."""
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
