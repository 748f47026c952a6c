"""Card-pipeline inputs derived from the driver's tables.

One ``events`` row is one authorization request.  The derivations are
plain column expressions, so they scale with the table and every row is
kept.  The mapping and the derived tables are the ones in FIXTURES.md.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.constants import STATUS_AUTHORIZED, STATUS_HELD
from cardflow.schemas import AMOUNT

# Fixed parameters of the derived fixture tables.
AMOUNT_FACTOR = 30
EARLY_SCORE_EVERY = 7          # every 7th score lands one second before its entry
RELEASE_EVERY = 10             # held rows with request_id % 10 = 0 are released
RELEASE_AFTER = "2 days"
DEFAULT_CUTOFF = dt.datetime(2024, 2, 15)
FIRST_CUTOFF = dt.datetime(2024, 1, 16)
# Encrypts the fixture's card numbers; a deployment's key comes from its session.
FIXTURE_PAN_KEY = "fixture-key-not-for-deployments!"


def requests(events: DataFrame) -> DataFrame:
    """Clean authorization requests, amount as text (FIXTURES §2)."""
    amount = (F.col("value").cast(AMOUNT) * F.lit(AMOUNT_FACTOR)).cast(AMOUNT)
    return events.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").alias("arrival"),
        F.concat(F.lit("merchant-"), F.col("event_type")).alias("merchantId"),
        F.concat(F.lit("41111111"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("pan"),
        amount.cast("string").alias("amount"),
        F.when(F.col("event_id") % 3 == 0, "USD").when(F.col("event_id") % 3 == 1, "EUR")
         .otherwise("GBP").alias("currency"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_type"),
                    F.col("ts").cast("date").cast("string")).alias("idempotencyKey"),
    )


def raw_requests(events: DataFrame) -> DataFrame:
    """Requests as a careless client sends them: every row is kept, and a
    deterministic share carries blanks, spaced card numbers, short card
    numbers, non-digits and non-breaking spaces in them, unparsable,
    over-precise or too large amounts, Unicode blanks, missing currencies
    and blank keys.  Used by the validation and parsing operators.
    """
    r = requests(events)
    rid = F.col("request_id")
    pan = F.col("pan")
    spaced = F.concat_ws(" ", F.substring(pan, 1, 4), F.substring(pan, 5, 4),
                         F.substring(pan, 9, 4), F.substring(pan, 13, 4))
    return r.select(
        "request_id", "arrival",
        F.when(rid % 97 == 0, F.lit(" \t ")).when(rid % 101 == 0, F.lit("\u3000\u2003"))
         .when(rid % 103 == 0, F.lit("\u00a0")).otherwise(F.col("merchantId")).alias("merchantId"),
        F.when(rid % 89 == 0, F.substring(pan, 1, 11)).when(rid % 11 == 0, spaced)
         .when(rid % 67 == 0, F.translate(spaced, " ", "\u00a0"))
         .when(rid % 59 == 0, F.concat(F.substring(pan, 1, 12), F.lit("ABCD")))
         .otherwise(pan).alias("pan"),
        F.when(rid % 83 == 0, F.lit("abc")).when(rid % 79 == 0, F.lit("1e3"))
         .when(rid % 61 == 0, F.concat(F.col("amount"), F.lit("5")))
         .when(rid % 53 == 0, F.lit("2500.004")).when(rid % 47 == 0, F.lit("2500.000"))
         .when(rid % 43 == 0, F.lit("12345678901234567.00"))
         .otherwise(F.col("amount")).alias("amount"),
        F.when(rid % 73 == 0, F.lit(None).cast("string")).otherwise(F.col("currency")).alias("currency"),
        F.when(rid % 71 == 0, F.lit("")).otherwise(F.col("idempotencyKey")).alias("idempotencyKey"),
    )


def order_requests(orders: DataFrame) -> DataFrame:
    """Every order as an authorization request (key = order key)."""
    return orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("arrival"),
        F.col("o_orderpriority").alias("merchantId"),
        F.concat(F.lit("41111111"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("pan"),
        F.col("o_totalprice").cast(AMOUNT).cast("string").alias("amount"),
        F.lit("USD").alias("currency"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("idempotencyKey"))


def scores(approved: DataFrame) -> DataFrame:
    """One score per stored transaction, with a fixture scoring time.

    ``approved`` are the APPROVED authorization outcomes (one per key,
    with the winning request's id and arrival).  Every seventh is scored
    one second *before* its feed entry (the early-score path), the others
    one to five hours after (FIXTURES §2).
    """
    from cardflow.constants import ALERT_ABOVE
    from cardflow.functions.scoring import default_score
    score = default_score(F.col("amount"))
    scored_at = (F.when(F.col("request_id") % EARLY_SCORE_EVERY == 0,
                        F.col("arrival") - F.expr("INTERVAL 1 SECOND"))
                 .otherwise(F.col("arrival") + F.make_dt_interval(
                     hours=(F.col("request_id") % 5 + 1).cast("int"))))
    return approved.select(
        "idempotencyKey", "transactionId", "request_id", "merchantId", "maskedPan",
        "amount", "currency", "arrival",
        score.alias("riskScore"), (score > ALERT_ABOVE).alias("alerted"),
        scored_at.alias("scored_at"))


def release_requests(scored: DataFrame) -> DataFrame:
    """Release requests for held rows with request_id % 10 = 0, two days
    after arrival (FIXTURES §2)."""
    return (scored.where(F.col("alerted") & (F.col("request_id") % RELEASE_EVERY == 0))
            .select("transactionId",
                    (F.col("arrival") + F.expr(f"INTERVAL {RELEASE_AFTER}")).alias("released_at")))


__all__ = ["requests", "raw_requests", "scores", "release_requests",
           "DEFAULT_CUTOFF", "FIRST_CUTOFF", "STATUS_AUTHORIZED", "STATUS_HELD"]
