"""Streaming authorization (K1, D1-D3 over micro-batches).

Two shapes:

* ``start_authorizer``: each micro-batch is authorized against the ledger
  of earlier batches, and its new rows, outcomes, rejects and receipts are
  published by one commit (``sinks.commits``); then its queue messages and
  topic records are sent, as the scorer and the velocity check read them.
  A replayed epoch finds its commit and writes nothing again, and a second
  writer of an epoch gets an error.
* ``first_per_key``: stateful streaming dedupe on the idempotency key in
  the state store, for sinks that only need the winners.  With a
  watermark the state is bounded, at the price that a key may be
  admitted again once its state expires.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardflow.session import stream_checkpoint
from cardflow.sinks import ledger as LG
from cardflow.sinks.commits import CommitLog


def authorize_batch(batch: DataFrame, ledger_path: str, out_root: str, epoch: str,
                    encrypt: bool = False) -> None:
    """One micro-batch; ``encrypt`` stores card numbers encrypted with the
    session's key."""
    from cardflow.plans.jobs import publish_pending, write_attempts
    log = CommitLog(batch.sparkSession, out_root, {LG.NEW: ledger_path, LG.RUNS: f"{ledger_path.rstrip('/')}_runs"})
    attempt = log.begin(epoch)
    if attempt.done is None:
        _, _, counts = write_attempts(attempt, batch, LG.read_rows(log, attempt.base), encrypt)
        attempt.commit(counts)
    publish_pending(log)
    LG.compact(log)


def start_authorizer(requests: DataFrame, ledger_path: str, out_root: str,
                     checkpoint: str | None = None, trigger: dict | None = None,
                     encrypt: bool = False) -> StreamingQuery:
    """Run K1 over a streaming DataFrame from ``read_requests(streaming=True)``.

    Requests need ``request_id`` and ``arrival``; the landing process
    assigns them.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        authorize_batch(batch, ledger_path, out_root, str(epoch), encrypt)

    ck = checkpoint or stream_checkpoint(requests.sparkSession, "authorizer", ledger_path)
    w = requests.writeStream.option("checkpointLocation", ck).foreachBatch(write)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def first_per_key(requests: DataFrame, key: str = "idempotencyKey",
                  event_ts: str | None = None, delay: str | None = None) -> DataFrame:
    """Streaming first-writer-wins on the key, kept in the state store.

    Without ``event_ts`` the state is unbounded (every key ever seen);
    with ``event_ts`` and ``delay`` it uses
    ``dropDuplicatesWithinWatermark``.
    """
    if event_ts and delay:
        return (requests.withColumn(event_ts, F.col(event_ts).cast("timestamp"))
                .withWatermark(event_ts, delay).dropDuplicatesWithinWatermark([key]))
    return requests.dropDuplicates([key])
