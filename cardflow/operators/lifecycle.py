"""Transaction lifecycle as an append-only event log and its fold
(S4, S5, F1, T5, L1-L5).

The stored row is never updated in place.  Every status change is a row
of ``status_events(idempotencyKey, status, event_ts, seq, source)`` and
the current status is the last event per key by (event_ts, seq): a
``max_by`` hash aggregation over fixed-width columns, partially
aggregated before the shuffle, so a key with many events costs one small
partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.constants import STATUS_AUTHORIZED, STATUS_HELD, STATUS_SETTLED, STATUSES
from cardflow.schemas import TRANSACTION_COLUMNS

KEY = "idempotencyKey"

SEQ_AUTHORIZE, SEQ_HOLD, SEQ_RELEASE, SEQ_SETTLE = 0, 1, 2, 3


def _ts(value):
    from cardflow.functions.text import ntz_lit
    return ntz_lit(value)


def events(keys: DataFrame, status: str, event_ts, seq: int, source: str) -> DataFrame:
    """Status events for every key of ``keys`` (one column ``idempotencyKey``).

    ``event_ts`` is a Column of ``keys`` or a fixed timestamp.
    """
    ts = F.col(event_ts) if isinstance(event_ts, str) else _ts(event_ts)
    return keys.select(F.col(KEY), F.lit(status).alias("status"), ts.alias("event_ts"),
                       F.lit(seq).cast("bigint").alias("seq"), F.lit(source).alias("source"))


def authorize_events(stored: DataFrame) -> DataFrame:
    """AUTHORIZED at creation for every stored row."""
    return events(stored, STATUS_AUTHORIZED, "createdAt", SEQ_AUTHORIZE, "authorize")


def status_update(ledger: DataFrame, updates: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """Status update by key (L1): (events, not_found).

    ``updates`` has ``idempotencyKey`` and ``event_ts``.  The update
    overwrites whatever the current status is; keys missing from the
    ledger are returned in ``not_found`` instead of failing the job.
    """
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}; expected one of {STATUSES}")
    found = updates.join(ledger.select(KEY), KEY, "left_semi")
    missing = updates.join(ledger.select(KEY), KEY, "left_anti")
    seq = {STATUS_HELD: SEQ_HOLD, STATUS_AUTHORIZED: SEQ_RELEASE, STATUS_SETTLED: SEQ_SETTLE}.get(status, 9)
    return events(found, status, "event_ts", seq, "update"), missing


def current_status(status_events: DataFrame, cutoff=None, guarded: bool = False) -> DataFrame:
    """Last status per key among events at or before ``cutoff`` (L1 fold).

    By default every event overwrites the status, whatever it was (so a
    score arriving after settlement re-holds a settled row, as an
    unconditional update does).  ``guarded=True`` makes SETTLED final:
    later holds or releases of a settled row are ignored.

    The fold is ``max_by`` of the status's position in the enumeration,
    ordered by one long (event time in microseconds x 16 + seq): both
    fixed-width, so the aggregation is a hash aggregation with map-side
    partial results.
    """
    from cardflow.functions.order import code_of, time_seq, value_of
    ev = status_events
    if cutoff is not None:
        ev = ev.where(F.col("event_ts") <= _ts(cutoff))
    folded = ev.groupBy(KEY).agg(
        F.max_by(code_of("status", STATUSES), time_seq("event_ts", "seq")).alias("_code"),
        F.max("event_ts").alias("status_ts"),
        F.max((F.col("status") == STATUS_SETTLED).cast("int")).alias("_settled"))
    status = value_of("_code", STATUSES)
    if guarded:
        status = F.when(F.col("_settled") == 1, F.lit(STATUS_SETTLED)).otherwise(status)
    return folded.select(KEY, status.alias("status"), "status_ts")


def current_rows(stored: DataFrame, status_events: DataFrame, cutoff=None,
                 guarded: bool = False) -> DataFrame:
    """Stored rows with their current status at ``cutoff``."""
    cur = current_status(status_events, cutoff, guarded)
    base = stored if cutoff is None else stored.where(F.col("createdAt") <= _ts(cutoff))
    return (base.drop("status").join(cur, KEY, "inner")
            .select(*TRANSACTION_COLUMNS))


def find_by_key(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Point lookup for a set of keys (S4): every key, with ``found`` and
    the stored row's columns (NULL when absent)."""
    stored = current.select(*[F.col(c).alias(c) for c in TRANSACTION_COLUMNS])
    return (keys.join(stored, KEY, "left")
            .withColumn("found", F.col("transactionId").isNotNull()))


def find(current: DataFrame, key: str) -> DataFrame:
    """Point lookup of one key (S4): zero or one row.  The equality filter
    reaches the parquet scan as a pushed filter when ``current`` is read
    from a table."""
    return current.where(F.col(KEY) == F.lit(key))


def find_by_status(current: DataFrame, status: str) -> DataFrame:
    """Every row in ``status``, oldest first.

    The sort is a range-partitioned distributed sort; the key breaks
    ties in createdAt so the order is total.
    """
    return current.where(F.col("status") == status).orderBy("createdAt", KEY)


def hold_events(scored: DataFrame) -> DataFrame:
    """HELD_FOR_REVIEW for every alerted row, at its scoring time (L2).

    An early score cannot precede its own authorization, so the event
    time is the later of the two.
    """
    held = scored.where(F.col("alerted"))
    return events(held.select(KEY, F.greatest("scored_at", "createdAt").alias("t")),
                  STATUS_HELD, "t", SEQ_HOLD, "hold")


def release(release_requests: DataFrame, entries: DataFrame, current: DataFrame | None = None,
            guarded: bool = False) -> tuple[DataFrame, DataFrame]:
    """Release held transactions by transaction id (L4, L5): (events, not_found).

    A release is accepted when the transaction has a feed entry recorded
    at or before the request; the old status is not checked unless
    ``guarded`` (then only HELD_FOR_REVIEW rows at ``current`` are
    released).  Released rows get AUTHORIZED and are not re-scored, so
    they settle in the next batch.
    """
    # every entry of a transaction has the same key: a grouping column, so
    # the aggregation buffer stays fixed-width
    first_seen = entries.groupBy("transactionId", KEY).agg(F.min("arrival").alias("first_arrival"))
    j = release_requests.join(first_seen, "transactionId", "left")
    ok = F.col("first_arrival").isNotNull() & (F.col("first_arrival") <= F.col("released_at"))
    accepted = j.where(ok)
    if guarded and current is not None:
        accepted = accepted.join(current.where(F.col("status") == STATUS_HELD).select(KEY), KEY, "left_semi")
    ev = events(accepted.select(KEY, "released_at"), STATUS_AUTHORIZED, "released_at",
                SEQ_RELEASE, "release")
    not_found = j.where(~ok).select("transactionId", "released_at")
    return ev, not_found


def settle_events(current: DataFrame, cutoff) -> DataFrame:
    """SETTLED at the cutoff for every row still AUTHORIZED (L3)."""
    return events(current.where(F.col("status") == STATUS_AUTHORIZED).select(KEY),
                  STATUS_SETTLED, cutoff, SEQ_SETTLE, "settle")


# name used in the operator inventory
hold = hold_events
