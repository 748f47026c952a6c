"""Reference SQL for the registered queries (ANSI SQL as DuckDB runs it).

Each oracle is written independently of the Spark plan, straight from the
semantics: windows with row_number where the Spark side aggregates, ASOF
joins where it resolves targets by aggregation.  Fragments below are CTE
bodies shared by several oracles.
"""

REQ = """req AS (
  SELECT event_id AS request_id,
         ts AS arrival,
         concat('merchant-', event_type) AS merchantId,
         concat('41111111', lpad(CAST(user_id AS VARCHAR), 8, '0')) AS pan,
         CAST(CAST(value AS DECIMAL(18,2)) * 30 AS DECIMAL(18,2)) AS amount,
         CASE event_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
         concat(CAST(user_id AS VARCHAR), '-', event_type, '-', CAST(CAST(ts AS DATE) AS VARCHAR)) AS idempotencyKey
  FROM events)"""

RAW = """raw AS (
  SELECT request_id, arrival,
         CASE WHEN request_id % 97 = 0 THEN ' ' || chr(9) || ' '
              WHEN request_id % 101 = 0 THEN chr(12288) || chr(8195)
              WHEN request_id % 103 = 0 THEN chr(160) ELSE merchantId END AS merchantId,
         CASE WHEN request_id % 89 = 0 THEN substr(pan, 1, 11)
              WHEN request_id % 11 = 0 THEN concat_ws(' ', substr(pan, 1, 4), substr(pan, 5, 4), substr(pan, 9, 4), substr(pan, 13, 4))
              WHEN request_id % 67 = 0 THEN concat_ws(chr(160), substr(pan, 1, 4), substr(pan, 5, 4), substr(pan, 9, 4), substr(pan, 13, 4))
              WHEN request_id % 59 = 0 THEN substr(pan, 1, 12) || 'ABCD'
              ELSE pan END AS pan,
         CASE WHEN request_id % 83 = 0 THEN 'abc'
              WHEN request_id % 79 = 0 THEN '1e3'
              WHEN request_id % 61 = 0 THEN CAST(amount AS VARCHAR) || '5'
              WHEN request_id % 53 = 0 THEN '2500.004'
              WHEN request_id % 47 = 0 THEN '2500.000'
              WHEN request_id % 43 = 0 THEN '12345678901234567.00'
              ELSE CAST(amount AS VARCHAR) END AS amount,
         CASE WHEN request_id % 73 = 0 THEN NULL ELSE currency END AS currency,
         CASE WHEN request_id % 71 = 0 THEN '' ELSE idempotencyKey END AS idempotencyKey
  FROM req)"""

# Attempts with their rank per key and the winner's request id.
ATT = """att AS (
  SELECT *, row_number() OVER (PARTITION BY idempotencyKey ORDER BY arrival, request_id) AS rn,
         first_value(request_id) OVER (PARTITION BY idempotencyKey ORDER BY arrival, request_id) AS winner_id
  FROM req)"""

# Stored rows: first attempt per key.
LED = """led AS (
  SELECT idempotencyKey,
         substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS transactionId,
         merchantId, '**** **** **** ' || right(pan, 4) AS maskedPan, CAST(NULL AS VARCHAR) AS encryptedPan,
         amount, currency, 'AUTHORIZED' AS status, arrival AS createdAt, request_id, arrival
  FROM (SELECT *, sha256(idempotencyKey) AS h FROM att WHERE rn = 1) x)"""

SCORES = """sc AS (
  SELECT idempotencyKey, transactionId, request_id, merchantId, maskedPan, amount, currency, arrival, createdAt,
         CASE WHEN amount > 2500 THEN 0.92 ELSE 0.15 END::DOUBLE AS riskScore,
         amount > 2500 AS alerted,
         CASE WHEN request_id % 7 = 0 THEN arrival - INTERVAL '1' SECOND
              ELSE arrival + ((request_id % 5) + 1) * INTERVAL '1' HOUR END AS scored_at
  FROM led)"""

ENTRIES = """ent AS (
  SELECT a.request_id, a.arrival, l.transactionId, l.idempotencyKey, l.merchantId, l.maskedPan,
         CAST(l.amount AS VARCHAR) AS amount, l.currency,
         a.rn = 1 AS is_new,
         CASE WHEN a.rn = 1 THEN 'receipts/' || l.merchantId || '/' || l.transactionId || '.json' END AS receiptKey
  FROM att a JOIN led l ON a.idempotencyKey = l.idempotencyKey)"""

# Status events: authorize, hold (alerted), release (held, request_id % 10 = 0, +2 days).
EVENTS = """ev AS (
  SELECT idempotencyKey, 'AUTHORIZED' AS status, createdAt AS event_ts, 0 AS seq FROM led
  UNION ALL
  SELECT idempotencyKey, 'HELD_FOR_REVIEW', greatest(scored_at, createdAt), 1 FROM sc WHERE alerted
  UNION ALL
  SELECT idempotencyKey, 'AUTHORIZED', arrival + INTERVAL '2' DAY, 2 FROM sc WHERE alerted AND request_id % 10 = 0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = with_(REQ, ATT, LED)
BASE_SC = with_(REQ, ATT, LED, SCORES)
BASE_EV = with_(REQ, ATT, LED, SCORES, EVENTS)


def fold(cutoff: str, extra_events: str = "") -> str:
    """Current status per key at a cutoff, as a CTE named ``cur``."""
    src = "ev" if not extra_events else f"(SELECT * FROM ev UNION ALL {extra_events})"
    return f"""cur AS (
  SELECT l.*, s.status AS cur_status FROM led l JOIN (
    SELECT idempotencyKey, arg_max(status, epoch_us(event_ts) * 10 + seq) AS status
    FROM {src} e WHERE event_ts <= TIMESTAMP '{cutoff}' GROUP BY idempotencyKey) s
  ON l.idempotencyKey = s.idempotencyKey WHERE l.createdAt <= TIMESTAMP '{cutoff}')"""

# JSON message body of a stored row (wire layout: nulls written, amount
# with its scale, createdAt as epoch seconds with nine decimals).
JSON_BODY = ("'{\"idempotencyKey\":\"' || idempotencyKey || '\",\"transactionId\":\"' || transactionId || "
             "'\",\"merchantId\":\"' || merchantId || '\",\"maskedPan\":\"' || maskedPan || "
             "'\",\"encryptedPan\":null,\"amount\":' || CAST(amount AS VARCHAR) || "
             "',\"currency\":\"' || currency || '\",\"status\":\"' || status || "
             "'\",\"createdAt\":' || CAST(epoch_us(createdAt) // 1000000 AS VARCHAR) || '.' || "
             "lpad(CAST(epoch_us(createdAt) % 1000000 AS VARCHAR), 6, '0') || '000}'")

REL = """rel AS (SELECT transactionId, arrival + INTERVAL '2' DAY AS released_at
  FROM sc WHERE alerted AND request_id % 10 = 0)"""

# Feed entries with their initial status (a duplicate shows the stored
# row's status as of its arrival, settlements included).
def entries0(events_cte: str) -> str:
    return f"""ent0 AS (
  SELECT e.*,
         CASE WHEN e.is_new THEN 'AUTHORIZED' ELSE
           (SELECT arg_max(x.status, epoch_us(x.event_ts) * 10 + x.seq) FROM {events_cte} x
            WHERE x.idempotencyKey = e.idempotencyKey AND x.event_ts <= e.arrival) END AS status0,
         CASE WHEN e.is_new THEN 'QUEUED' ELSE 'RECORDED' END AS stage0
  FROM ent e)"""


# Each action's target entry: newest entry at or before the action; a
# score with none goes to the first entry after it.
TARGETS = """tgt AS (
  SELECT a.*, coalesce(b.request_id, CASE WHEN a.kind = 'score' THEN f.request_id END) AS target,
         CASE WHEN b.request_id IS NOT NULL THEN a.action_ts ELSE f.arrival END AS eff_ts
  FROM acts a
  ASOF LEFT JOIN ent b ON a.transactionId = b.transactionId AND a.action_ts >= b.arrival
  ASOF LEFT JOIN (SELECT * FROM ent) f ON a.transactionId = f.transactionId AND a.action_ts < f.arrival)"""

STATE = """st AS (
  SELECT target,
    arg_max(CASE kind WHEN 'settle' THEN 'SETTLED' WHEN 'release' THEN 'SCORED'
                      ELSE CASE WHEN alerted THEN 'ALERTED' ELSE 'SCORED' END END,
            (epoch_us(eff_ts), seq, epoch_us(action_ts))) AS stage,
    arg_max(CASE kind WHEN 'settle' THEN 'SETTLED' WHEN 'release' THEN 'AUTHORIZED' ELSE 'HELD_FOR_REVIEW' END,
            (epoch_us(eff_ts), seq, epoch_us(action_ts))) FILTER (WHERE kind <> 'score' OR alerted) AS status,
    arg_max(riskScore, (epoch_us(eff_ts), seq, epoch_us(action_ts))) FILTER (WHERE kind = 'score') AS riskScore,
    max(eff_ts) AS updatedAt
  FROM tgt WHERE target IS NOT NULL GROUP BY target)"""

FEED = """feed AS (
  SELECT e.request_id, e.arrival, e.transactionId, e.idempotencyKey, e.merchantId, e.maskedPan, e.amount,
         e.currency, coalesce(st.status, e.status0) AS status, coalesce(st.stage, e.stage0) AS stage,
         st.riskScore, e.receiptKey, coalesce(st.updatedAt, e.arrival) AS updatedAt
  FROM ent0 e LEFT JOIN st ON e.request_id = st.target)"""
