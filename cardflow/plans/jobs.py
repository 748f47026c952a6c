"""The pipeline as a batch job over tables: one call per batch of requests.

``run_batch`` reads a landing folder of authorization requests and the
tables written by earlier batches under ``root``, and writes this batch's
outputs, each to a folder of its own; one commit publishes all of them
(``sinks.commits``), and a batch that is committed is not run again:

    root/ledger          stored transactions (first writer per key), a run per batch
    root/ledger_runs     the same, merged (``sinks.ledger``)
    root/outcomes        one row per attempt (APPROVED / DUPLICATE)
    root/rejected        requests failing validation
    root/receipts        receipt documents by merchant bucket, and
    root/receipt_index   which file holds which receipt
    root/release_not_found  release requests of unknown transactions
    root/alerts          high-risk alerts
    root/status_events   authorize / hold / release / settle events
    root/settlements     summary document and settled ids per settlement batch
    root/notices         settlement notices
    root/open            rows that can still settle (``operators.snapshot``), with
    root/waiting_rows, root/waiting_events   what was after the last cutoff

Messages go out after the commit, from what it holds; a batch whose messages
were not sent is caught up by the next run:

    root/fraud_queue     fraud-check messages (JSON, as ``read_fraud_queue`` reads them)
    root/topic           transaction topic records (JSON, as ``read_topic`` reads them)

Scoring happens in the same job here (scored at creation time); a
deployment with a separate scorer runs ``streaming.scoring`` on the queue.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.constants import OUTCOME_APPROVED, STATUS_SETTLED
from cardflow.functions.text import batch_id as make_batch_id, ntz_lit
from cardflow.operators import lifecycle as L
from cardflow.operators import settlement as S
from cardflow.operators import snapshot as P
from cardflow.operators.authorize import authorize, new_rows, normalize_once
from cardflow.operators.scoring import fraud_alerts, score
from cardflow.schemas import STATUS_EVENT, TRANSACTION
from cardflow.session import child_folders, materialize, pan_key
from cardflow.sinks import ledger as LG
from cardflow.sinks.commits import Batch, CommitLog
from cardflow.sinks.messages import publish_queue, publish_topic
from cardflow.sinks.writers import write_receipt_index, write_receipts, write_summary
from cardflow.sources.readers import find_receipt

SNAPSHOT = "open"


def publish_pending(log: CommitLog) -> int:
    """Send the messages of committed batches that have not been sent; the
    number of batches.  Sending again (after a failure before the mark)
    rewrites the batch's folders with the same records."""
    sent = set(child_folders(log.spark, f"{log.root}/_published"))
    due = [f for f in log.state().folders(LG.NEW) if f"batch={f.batch_id}" not in sent]
    for f in due:
        rows = log.spark.read.schema(TRANSACTION).parquet(f.path)
        publish_queue(rows, f"{log.root}/fraud_queue", f.batch_id)
        publish_topic(rows, f"{log.root}/topic", f.batch_id)
        mark = log.spark._jvm.org.apache.hadoop.fs.Path(f"{log.root}/_published/batch={f.batch_id}")
        mark.getFileSystem(log.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(mark)
    return len(due)


def write_attempts(batch: Batch, requests: DataFrame, ledger: DataFrame | None,
                   encrypt: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """The tables a batch of requests makes: (outcomes, stored rows, counts)."""
    spark = batch.log.spark
    valid, rejected = normalize_once(requests, "job-requests")
    outcomes = batch.write(authorize(valid, ledger=ledger, batch_id=batch.batch_id, written=True,
                                     key=pan_key(spark) if encrypt else None).drop("is_new"), "outcomes")
    outcomes = outcomes.withColumn("is_new", F.col("outcome") == OUTCOME_APPROVED)
    stored = LG.add_rows(batch, new_rows(outcomes))
    bad = batch.write(rejected, "rejected")
    receipts = batch.folder("receipts")
    write_receipts(stored, "", "", folder=receipts)
    write_receipt_index(spark, f"{receipts}/*", batch.folder("receipt_index"))
    # counted from what was written: the footers hold the numbers of rows
    n = bad.count()
    return outcomes, stored, {"requests": outcomes.count() + n, "stored": stored.count(), "rejected": n}


def receipt(log: CommitLog, key: str) -> DataFrame | None:
    """A committed receipt by its key (S6): one file is opened."""
    return find_receipt(log.spark, [f.path for f in log.state().folders("receipt_index")], key)


def _events(log: CommitLog, state, after: int = -1) -> DataFrame:
    found = log.read("status_events", state=state, after=after)
    return log.spark.createDataFrame([], STATUS_EVENT) if found is None else found.select(*STATUS_EVENT.fieldNames())


def _rows(log: CommitLog, state) -> DataFrame:
    found = LG.read_rows(log, state)
    return log.spark.createDataFrame([], TRANSACTION) if found is None else found.drop("batch_id")


def release_targets(batch: Batch, releases: DataFrame, stored: DataFrame) -> DataFrame:
    """transactionId, idempotencyKey and arrival of the rows that releases
    name: a transaction's first entry is the attempt that stored it.  Rows
    of this batch and open ones come first; the ledger is asked only for
    the rest, by three columns."""
    log, state = batch.log, batch.base
    wanted = releases.select("transactionId").distinct()
    cols = ["transactionId", L.KEY, F.col("createdAt").alias("arrival")]
    near = stored.unionByName(LG.rows_since(log, state)).select(*cols)
    snapshot = log.read(SNAPSHOT, state=state)
    if snapshot is not None:
        near = near.unionByName(snapshot.select(*cols))
    near = materialize(near.join(wanted, "transactionId", "left_semi").dropDuplicates(["transactionId"]), "release-near")
    rest = materialize(wanted.join(near, "transactionId", "left_anti"), "release-rest")
    if not rest.limit(1).count():
        return near
    far = _rows(log, state).select(*cols).join(rest, "transactionId", "left_semi")
    return materialize(near.unionByName(far), "release-targets")


def fold_open(batch: Batch, stored: DataFrame, events: DataFrame, cutoff: dt.datetime) -> tuple[P.Fold, bool]:
    """The rows a settlement at ``cutoff`` looks at, from the snapshot and
    what came since; and whether a new snapshot can follow (not for a cutoff
    before the last one's: then the whole history is folded)."""
    log, state = batch.log, batch.base
    folders = state.folders(SNAPSHOT)
    last = folders[-1] if folders else None
    if last is not None and cutoff.isoformat() < state.results[last.batch_id]["cutoff"]:
        rows, ev = _rows(log, state).unionByName(stored), _events(log, state).unionByName(events)
        # what a later cutoff settled is not settled again
        later = ev.where((F.col("status") == STATUS_SETTLED) & (F.col("event_ts") > ntz_lit(cutoff))).select(L.KEY)
        rows = rows.join(later, L.KEY, "left_anti")
        return P.Fold(materialize(P.positioned(rows, ev, cutoff), "current"), rows.limit(0), ev.limit(0)), False
    after = last.seq if last is not None else -1
    rows, ev = LG.rows_since(log, state).unionByName(stored), _events(log, state, after).unionByName(events)
    for name, what in (("waiting_rows", TRANSACTION), ("waiting_events", STATUS_EVENT)):
        waiting = log.read(name, state=state)
        if waiting is not None:
            waiting = waiting.select(*what.fieldNames())
            rows, ev = (rows.unionByName(waiting), ev) if what is TRANSACTION else (rows, ev.unionByName(waiting))

    def history(keys: DataFrame) -> DataFrame:
        return P.positioned(_rows(log, state).join(keys, L.KEY, "left_semi"),
                            _events(log, state).join(keys, L.KEY, "left_semi"), cutoff)

    return P.fold(log.read(SNAPSHOT, state=state), rows, ev, cutoff, history if last is not None else None), True


def settle_batch(batch: Batch, stored: DataFrame, events: DataFrame, settle_at: dt.datetime) -> tuple[DataFrame, dict]:
    """Settle at ``settle_at`` what is AUTHORIZED, this batch's rows and
    events included: (settle events, counts)."""
    settle_id = make_batch_id(settle_at, batch.batch_id)
    f, follows = fold_open(batch, stored, events, settle_at)
    settled, _, _ = S.settle(f.current, settle_at, settle_id)
    n = write_summary(f.current, batch.folder("settlements"), settle_id, settle_at)
    batch.write(S.settlement_notice(S.summary(f.current, settle_id, settle_at)), "notices")
    if follows:
        batch.clear(LG.SINCE)
        for name, df in ((SNAPSHOT, f.open_rows()), ("waiting_rows", f.waiting_rows), ("waiting_events", f.waiting_events)):
            batch.clear(name)
            batch.write(df, name)
    return settled, {"settlement": settle_id, "settled": n, "cutoff": settle_at.isoformat()}


def run_batch(spark: SparkSession, requests: DataFrame, root: str, batch_id: str,
              settle_at: dt.datetime | None = None, releases: DataFrame | None = None,
              encrypt: bool = False) -> dict:
    """Authorize, score, release and (optionally) settle one batch; returns
    counts.  A batch that is committed already returns the counts it had;
    another writer that commits meanwhile raises ``CommitConflict``.

    ``releases`` (transactionId, released_at) frees held transactions that
    this batch or an earlier one recorded before the request; the others go
    to ``release_not_found``.  ``encrypt`` stores card numbers encrypted with
    the session's key.
    """
    log = CommitLog(spark, root)
    batch = log.begin(batch_id)
    if batch.done is None:
        outcomes, stored, counts = write_attempts(batch, requests, LG.read_rows(log, batch.base), encrypt)
        scored = score(stored).withColumn("scored_at", F.col("createdAt"))
        batch.write(fraud_alerts(scored), "alerts")
        events = L.authorize_events(stored).unionByName(L.hold_events(scored))
        if releases is not None:
            freed, missing = L.release(releases, release_targets(batch, releases, stored))
            events = events.unionByName(freed)
            batch.write(missing, "release_not_found")
        events = materialize(events, "job-events")
        if settle_at is not None:
            settled, more = settle_batch(batch, stored, events, settle_at)
            events = events.unionByName(settled)
            counts.update(more)
        batch.write(events, "status_events")
        batch.commit(counts)
    publish_pending(log)
    LG.compact(log)
    return log.state().results[batch_id]
