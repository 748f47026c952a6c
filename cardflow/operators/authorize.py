"""Request normalization and first-writer-wins authorization (P4-P7, P13,
D1-D3, J1, J2, K1).

Plan shape (checked with ``explain``): the checked requests are written
once.  The first attempt per idempotency key, with its row, is one
aggregation whose partial results hold a row per key and task, also for a key
with a third of all requests; it meets the ledger (one row per key on either
side), and the resolution per key (winner, stored row) is written once.  The
attempts are then joined to it: both sides are scans of written tables, so
the planner knows their sizes and AQE splits a key with very many attempts by
itself.  No window is partitioned by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.constants import OUTCOME_APPROVED, OUTCOME_DUPLICATE, STATUS_AUTHORIZED
from cardflow.functions.pan import encrypt_pan, mask_pan, strip_spaces
from cardflow.functions.requests import (
    default_key, fields_ok, parse_amount, transaction_id, validation_labels, validation_message,
)
from cardflow.functions.order import time_id
from cardflow.functions.text import receipt_key
from cardflow.schemas import TRANSACTION_COLUMNS
from cardflow.session import materialize

KEY = "idempotencyKey"
# Attempt order: arrival time, then the request id as the unique tie-break.
ORDER = ["arrival", "request_id"]


def _checked(requests: DataFrame, strict: bool) -> DataFrame:
    """Requests with the card number stripped, the amount parsed, ``_ok``
    (the cheap boolean decision)."""
    r = requests.withColumn("pan", strip_spaces("pan"))
    amount = parse_amount("amount")
    checked = r.select(*[c for c in r.columns if c != "amount"],
                       F.col("amount").alias("amount_text"), amount.alias("amount"))
    ok = F.coalesce(fields_ok(amount="amount_text", strict=strict) & F.col("amount").isNotNull(),
                    F.lit(False))
    return checked.withColumn("_ok", ok)


def _error(strict: bool) -> Column:
    """Why a checked request fails (built only when it does)."""
    labels = validation_labels(amount="amount_text", strict=strict)
    error = F.coalesce(
        validation_message(labels),
        F.concat(F.lit("Invalid amount: "), F.coalesce(F.col("amount_text"), F.lit("null"))))
    return F.when(~F.col("_ok"), error).alias("error")


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` through a generator: a filter on its columns is not pushed below
    it, where the optimizer would put their whole expressions in place of
    them and compute each many times a row."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def normalize_requests(requests: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split raw requests into (valid, rejected).

    valid: request_id, arrival, merchantId, pan (spaces removed),
    amount DECIMAL(18,2), currency, idempotencyKey (generated when blank).
    rejected: request_id, arrival, error (the validation message, or
    ``Invalid amount: <text>`` when the amount does not parse).
    """
    return _split(_flagged(requests, strict))


def normalize_once(requests: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``normalize_requests`` with the checked requests written once, so that
    a source read for both outputs is read and parsed once."""
    return _split(materialize(_flagged(requests, False), name))


def _flagged(requests: DataFrame, strict: bool) -> DataFrame:
    return computed_once(_checked(requests, strict)).select(
        "request_id", "arrival", "merchantId", "pan", "amount", "currency",
        default_key(KEY, "request_id").alias(KEY), "_ok", _error(strict))


def _split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (flagged.where(F.col("_ok")).drop("_ok", "error"),
            flagged.where(~F.col("_ok")).select("request_id", "arrival", "error"))


def request_errors(requests: DataFrame, strict: bool = False) -> DataFrame:
    """One pass over the requests: request_id and error (NULL when valid)."""
    return _checked(requests, strict).select("request_id", _error(strict))


def to_transactions(valid: DataFrame, key: Column | None = None) -> DataFrame:
    """Candidate transaction row per attempt.

    Keeps request_id and arrival for ordering; createdAt is the arrival
    time, so reruns give the same rows.
    """
    return valid.select(
        "request_id", "arrival",
        F.col(KEY),
        transaction_id(F.col(KEY)).alias("transactionId"),
        "merchantId",
        mask_pan("pan").alias("maskedPan"),
        encrypt_pan("pan", key).alias("encryptedPan"),
        "amount", "currency",
        F.lit(STATUS_AUTHORIZED).alias("status"),
        F.col("arrival").alias("createdAt"),
    )


def _row(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in TRANSACTION_COLUMNS])


def resolution(valid: DataFrame, ledger: DataFrame | None = None, key: Column | None = None,
               batch_id: str | None = None) -> DataFrame:
    """One row per idempotency key of ``valid``: ``rid`` (request id of its
    first attempt by arrival and request id), ``row`` (what that attempt
    would store) and ``stored`` (the ledger's row, NULL if there is none)."""
    first = valid.groupBy(KEY).agg(F.min_by(F.struct(*[c for c in valid.columns if c != KEY]), time_id(*ORDER)).alias("w"))
    won = to_transactions(first.select(KEY, "w.*"), key).select(KEY, F.col("request_id").alias("rid"), _row().alias("row"))
    if ledger is None:
        return won.withColumn("stored", F.lit(None).cast(won.schema["row"].dataType))
    if batch_id is not None and "batch_id" in ledger.columns:
        ledger = ledger.where(F.col("batch_id").isNull() | (F.col("batch_id") != F.lit(batch_id)))
    return won.join(ledger.select(F.col(KEY), _row().alias("stored")), KEY, "left")


def authorize(valid: DataFrame, ledger: DataFrame | None = None,
              key: Column | None = None, batch_id: str | None = None,
              written: bool = False) -> DataFrame:
    """Outcome per attempt.

    The first attempt per idempotency key (by arrival, request_id) that
    is not already in ``ledger`` is APPROVED and carries a receipt key;
    every other attempt is a DUPLICATE carrying the *stored* row and a
    NULL receipt key, even when its own payload differs.

    ``ledger`` rows (TRANSACTION columns, optional ``batch_id``) are the
    keys stored by earlier runs; rows written by ``batch_id`` itself are
    ignored, so replaying a batch reproduces the same outcomes.
    ``written`` says that ``valid`` is a table already; else it is written
    here, so that requests are read and checked once.

    Output: request_id, arrival, outcome, receiptKey, is_new, and the
    TRANSACTION columns of the row the attempt resolves to.
    """
    if not written:
        valid = materialize(valid, "requests")
    res = materialize(resolution(valid, ledger, key, batch_id), "resolution")
    j = valid.select(KEY, *ORDER).join(res, KEY)
    is_new = F.col("stored").isNull() & (F.col("request_id") == F.col("rid"))
    out = j.select(
        "request_id", "arrival",
        F.when(is_new, F.lit(OUTCOME_APPROVED)).otherwise(F.lit(OUTCOME_DUPLICATE)).alias("outcome"),
        is_new.alias("is_new"),
        F.coalesce(F.col("stored"), F.col("row")).alias("t"),
    )
    return out.select(
        "request_id", "arrival", "outcome", "is_new",
        *[F.col("t." + c).alias(c) for c in TRANSACTION_COLUMNS],
    ).withColumn("receiptKey", F.when(F.col("is_new"), receipt_key("merchantId", "transactionId")))


def new_rows(outcomes: DataFrame) -> DataFrame:
    """The rows to store: winners not already in the ledger (K1, D3)."""
    return outcomes.where(F.col("is_new")).select(*TRANSACTION_COLUMNS)


def duplicates_by_merchant(outcomes: DataFrame) -> DataFrame:
    """Attempt counts per merchant of the stored row: approved, duplicate."""
    return (outcomes.groupBy("merchantId")
            .agg(F.count(F.when(F.col("is_new"), 1)).alias("approved"),
                 F.count(F.when(~F.col("is_new"), 1)).alias("duplicates")))
