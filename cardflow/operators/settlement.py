"""Settlement batches (L3, A1, A2, K3, K7).

A batch at cutoff T folds every status event up to T, takes each row
still AUTHORIZED, and produces: SETTLED events, a one-row summary
(count and exact decimal total; an empty batch is count 0, total 0), the
settled ids as *rows* (oldest first when sorted), and a notice.  The
total is a global aggregate: partial sums per task, one tiny final
merge, no data in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.operators.lifecycle import KEY, settle_events
from cardflow.functions.text import (
    iso_instant, ntz_lit, plain_total, settlement_message, settlement_subject, summary_key,
)
from cardflow.schemas import TOTAL
from cardflow.constants import STATUS_AUTHORIZED


def eligible(current: DataFrame) -> DataFrame:
    """Rows still AUTHORIZED (F1)."""
    return current.where(F.col("status") == STATUS_AUTHORIZED)


def totals(current: DataFrame, by_currency: bool = False) -> DataFrame:
    """Count and exact total of the eligible rows (A1).

    Amounts of different currencies are added together, as the batch
    does; ``by_currency=True`` gives one row per currency instead.
    Without grouping the result always has exactly one row.
    """
    e = eligible(current)
    aggs = [F.count(F.lit(1)).alias("transactionCount"),
            F.coalesce(F.sum("amount"), F.lit(0)).cast(TOTAL).alias("totalAmount")]
    if by_currency:
        return e.groupBy("currency").agg(*aggs)
    return e.agg(*aggs)


def settled_ids(current: DataFrame, batch_id: str) -> DataFrame:
    """Settled transaction ids as rows, sorted oldest first (A2).

    Rows rather than one array, so the list never passes through a
    single task; the sort is distributed.
    """
    return (eligible(current)
            .select(F.lit(batch_id).alias("batchId"), "transactionId", "createdAt", KEY)
            .orderBy("createdAt", KEY))


def summary(current: DataFrame, batch_id: str, settled_at) -> DataFrame:
    """One summary row: batchId, settledAt, transactionCount, totalAmount,
    batchSummaryKey, subject, message (K3, K7)."""
    t = totals(current)
    return t.select(
        F.lit(batch_id).alias("batchId"),
        ntz_lit(settled_at).alias("settledAt"),
        F.col("transactionCount"), F.col("totalAmount"),
        summary_key(F.lit(batch_id)).alias("batchSummaryKey"),
        settlement_subject(F.lit(batch_id)).alias("subject"),
        settlement_message(F.col("transactionCount"), F.col("totalAmount")).alias("message"),
    )


def summary_document(current: DataFrame, batch_id: str, settled_at, ids_path: str) -> DataFrame:
    """The summary document's columns (K3), one schema at every size: the
    settled ids are a dataset of their own, named by path and row count;
    ``settledAt`` is an ISO instant and an empty batch's total is ``0``."""
    s = summary(current, batch_id, settled_at)
    return s.select(
        "batchId", iso_instant("settledAt").alias("settledAt"), "transactionCount",
        plain_total("transactionCount", "totalAmount").alias("totalAmount"),
        F.lit(ids_path).alias("transactionIdsPath"),
        F.col("transactionCount").alias("transactionIdsCount"))


def settle(current: DataFrame, cutoff, batch_id: str, by_currency: bool = False):
    """(events, summary, ids) of one batch over the current view (L3).

    ``by_currency=True`` gives the summary as one row per currency
    (batchId, currency, transactionCount, totalAmount) instead of the
    single all-currency row.
    """
    if by_currency:
        head = totals(current, by_currency=True).select(
            F.lit(batch_id).alias("batchId"), "currency", "transactionCount", "totalAmount")
    else:
        head = summary(current, batch_id, cutoff)
    return settle_events(current, cutoff), head, settled_ids(current, batch_id)


def settlement_notice(batch_summary: DataFrame) -> DataFrame:
    """Notification rows (K7): batchId, subject, message, from ``summary``."""
    return batch_summary.select("batchId", "subject", "message")
