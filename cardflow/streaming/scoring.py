"""Streaming fraud scoring.

``readStream`` of fraud-check messages -> decode -> score -> per
micro-batch: alerts, hold events, scores and dead letters, each written to
its own ``batch_id=<epoch>`` partition.  The source offsets are committed
only after the batch's writes succeed (at-least-once delivery), and a
replayed epoch overwrites its own partitions, so outputs are effectively
once.  A malformed body goes to ``dead_letter`` immediately and the rest of
the batch is processed.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardflow.constants import ALERT_ABOVE
from cardflow.operators.lifecycle import hold_events
from cardflow.operators.scoring import fraud_alerts, score
from cardflow.session import delete_path, materialize, path_exists, stream_checkpoint
from cardflow.sinks.writers import append_batch
from cardflow.sources.readers import decode_messages, parse_messages


def score_batch(messages: DataFrame, score_fn: Callable[[DataFrame], Column] | None = None,
                alert_above: float = ALERT_ABOVE) -> dict[str, DataFrame]:
    """One micro-batch's outputs: scores, alerts, holds, dead_letter."""
    good, dead = decode_messages(messages, keep=["sent_at"])
    sc = score(good, score_fn, alert_above)
    # scoring time: the message's send time when present, else creation
    # time, so a replayed batch produces the same rows
    sent = F.col("sent_at").cast("timestamp_ntz") if "sent_at" in good.columns else F.lit(None)
    sc = sc.withColumn("scored_at", F.coalesce(sent, F.col("createdAt")).cast("timestamp_ntz"))
    return {
        "scores": sc.select("transactionId", "riskScore", "alerted", "scored_at"),
        "alerts": fraud_alerts(sc),
        "holds": hold_events(sc),
        "dead_letter": dead,
    }


def score_epoch(batch: DataFrame, out_root: str, epoch: int, max_receives: int,
                score_fn: Callable[[DataFrame], Column] | None = None, alert_above: float = ALERT_ABOVE) -> None:
    """One micro-batch with redelivery (Q1, Q2): a message that cannot be
    decoded or gets no score is received again with the next batch, and
    leaves as a dead letter at its ``max_receives``-th failure.

    The messages that wait are a table per epoch below ``out_root``/retry,
    with the number of times each was received (``receives``, which a
    ``score_fn`` may read).  An epoch reads the one before it and writes its
    own, so a replayed epoch counts nothing twice; states before that are
    deleted.
    """
    spark, out = batch.sparkSession, out_root.rstrip("/")
    state = lambda n: f"{out}/retry/epoch={n}"
    fields = ["body", "amount", "sent_at"]
    both = batch.select(*fields, F.lit(1).alias("receives"))
    if epoch > 0 and path_exists(spark, state(epoch - 1)):
        both = both.unionByName(spark.read.parquet(state(epoch - 1)).select(*fields, (F.col("receives") + 1).alias("receives")))
    parsed = materialize(parse_messages(both), f"scoring-{epoch}")
    good, _ = decode_messages(parsed, keep=["sent_at", "receives", "body"])
    # the amount attribute of the message waits with it
    good = good.withColumn("_attribute", F.col("amount").cast("string"))
    scored = score(good, score_fn, alert_above)
    scored = materialize(scored.withColumn("scored_at", F.coalesce(F.col("sent_at").cast("timestamp_ntz"), F.col("createdAt"))
                                           .cast("timestamp_ntz")), f"scored-{epoch}")
    done = scored.where(F.col("riskScore").isNotNull())
    readable = F.col("t.idempotencyKey").isNotNull() & F.col("t.transactionId").isNotNull()
    failed = parsed.where(~F.coalesce(readable, F.lit(False))).select(
        *fields, "receives", F.lit("unparsable message body").alias("reason")).unionByName(
        scored.where(F.col("riskScore").isNull()).select(
            "body", F.col("_attribute").alias("amount"), "sent_at", "receives", F.lit("no score").alias("reason")))
    last = F.col("receives") >= max_receives
    for name, df in {"scores": done.select("transactionId", "riskScore", "alerted", "scored_at"),
                     "alerts": fraud_alerts(done), "holds": hold_events(done),
                     "dead_letter": failed.where(last).select("body", "reason", "receives")}.items():
        append_batch(df, f"{out}/{name}", str(epoch))
    failed.where(~last).select(*fields, "receives").write.mode("overwrite").parquet(state(epoch))
    if epoch > 1:
        delete_path(spark, state(epoch - 2))


def start_scoring(messages: DataFrame, out_root: str, checkpoint: str | None = None,
                  score_fn: Callable[[DataFrame], Column] | None = None,
                  trigger: dict | None = None, max_receives: int | None = None) -> StreamingQuery:
    """Run W7: ``messages`` is a streaming DataFrame from ``read_fraud_queue``.

    With ``max_receives`` a message that fails is received again with the
    following micro-batches, that many times in all (``score_epoch``);
    without it a malformed one is a dead letter at once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if max_receives is not None:
            score_epoch(batch, out_root, epoch, max_receives, score_fn)
            return
        # one read and one decode for the four outputs of this micro-batch
        parsed = materialize(parse_messages(batch), f"scoring-{epoch}")
        for name, df in score_batch(parsed, score_fn).items():
            append_batch(df, f"{out_root.rstrip('/')}/{name}", str(epoch))

    ck = checkpoint or stream_checkpoint(messages.sparkSession, "scoring", out_root)
    w = messages.writeStream.option("checkpointLocation", ck).foreachBatch(write)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
