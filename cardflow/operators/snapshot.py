"""Settlement from a snapshot and what came since.

The snapshot holds the rows that can still settle: those not settled, with
their last status and the position of the event that set it.  A settlement
folds it with the rows and events since, not with history.  An event on a key
that neither has (a settled one, held again by a late score) needs the key's
past: only then the history of those keys is looked up.  Events and rows after
the cutoff wait for the next settlement.  The result is that of the full fold
(``lifecycle.current_rows``) at the cutoff, restricted to rows that are open or
were touched, and so holds every row that is AUTHORIZED.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.constants import STATUS_HELD, STATUSES
from cardflow.functions.order import code_of, time_seq, value_of
from cardflow.functions.text import ntz_lit
from cardflow.operators.lifecycle import KEY
from cardflow.schemas import TRANSACTION_COLUMNS
from cardflow.session import materialize

PAYLOAD = [c for c in TRANSACTION_COLUMNS if c != "status"]


@dataclass
class Fold:
    """``current``: open and touched rows with their status at the cutoff and
    its position; ``waiting_rows`` and ``waiting_events``: after the cutoff."""
    current: DataFrame
    waiting_rows: DataFrame
    waiting_events: DataFrame

    def open_rows(self) -> DataFrame:
        """What the next snapshot holds once the AUTHORIZED rows are settled."""
        return self.current.where(F.col("status") == STATUS_HELD)


def positioned(rows: DataFrame, events: DataFrame, cutoff) -> DataFrame:
    """The full fold: rows with their status at the cutoff and the position
    of the event that set it (the form of a snapshot)."""
    ev = events.where(F.col("event_ts") <= ntz_lit(cutoff))
    last = _last(ev.select(KEY, code_of("status", STATUSES).alias("_code"), time_seq("event_ts", "seq").alias("position")))
    return (rows.where(F.col("createdAt") <= ntz_lit(cutoff)).select(*PAYLOAD).join(last, KEY)
            .select(*TRANSACTION_COLUMNS, "position"))


def _last(codes: DataFrame) -> DataFrame:
    return (codes.groupBy(KEY).agg(F.max_by("_code", "position").alias("_code"), F.max("position").alias("position"))
            .select(KEY, value_of("_code", STATUSES).alias("status"), "position"))


def fold(snapshot: DataFrame | None, rows: DataFrame, events: DataFrame, cutoff,
         history: Callable[[DataFrame], DataFrame] | None = None) -> Fold:
    """Fold ``snapshot`` (TRANSACTION columns and position) with the ``rows``
    and ``events`` since; ``history`` gives snapshot rows for keys (one
    column) that are neither in it nor among the rows."""
    at = ntz_lit(cutoff)
    due, now = rows.where(F.col("createdAt") <= at), events.where(F.col("event_ts") <= at)
    known = due.select(*PAYLOAD)
    codes = now.select(KEY, code_of("status", STATUSES).alias("_code"), time_seq("event_ts", "seq").alias("position"))
    before = []
    if snapshot is not None:
        before.append(snapshot)
        known = known.unionByName(snapshot.select(*PAYLOAD))
    if history is not None:
        strange = materialize(now.select(KEY).distinct().join(rows.select(KEY), KEY, "left_anti")
                              .join(known.select(KEY), KEY, "left_anti"), "strange-keys")
        if strange.limit(1).count():
            past = materialize(history(strange), "past")
            before.append(past)
            known = known.unionByName(past.select(*PAYLOAD))
    for b in before:
        codes = codes.unionByName(b.select(KEY, code_of("status", STATUSES).alias("_code"), "position"))
    current = known.join(_last(codes), KEY).select(*TRANSACTION_COLUMNS, "position")
    return Fold(materialize(current, "current"), rows.where(F.col("createdAt") > at), events.where(F.col("event_ts") > at))
