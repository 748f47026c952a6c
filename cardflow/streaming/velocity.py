"""Velocity check as a Structured Streaming query.

Tumbling event-time windows per card with a watermark equal to the grace
period; counts are emitted in update mode (3, then 4, ...).  State lives
in the configured state store (RocksDB) under the query's checkpoint, so a
restarted query resumes with its counts.  Records behind the watermark
are dropped by Spark; note that the watermark used for a micro-batch is
the one computed at the end of the *previous* batch, so lateness is
judged per batch, not per record (the batch operator ``drop_late`` is the
per-record rule).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cardflow.constants import (
    VELOCITY_ALERT_TEMPLATE, VELOCITY_GRACE, VELOCITY_THRESHOLD, VELOCITY_WINDOW,
)
from cardflow.functions.text import ntz_lit
from cardflow.session import stream_checkpoint
from cardflow.sinks.writers import append_batch


def velocity_counts(records: DataFrame, size: str = VELOCITY_WINDOW, grace: str = VELOCITY_GRACE,
                    ts: str = "event_ts", key: str = "key") -> DataFrame:
    """Windowed count per key over a stream (or a batch: the watermark is
    then ignored).  ``ts`` must be TIMESTAMP (watermarks reject NTZ)."""
    r = records.withColumn(ts, F.col(ts).cast("timestamp"))
    return (r.withWatermark(ts, grace)
            .groupBy(F.window(ts, size).alias("window"), F.col(key).alias("key"))
            .agg(F.count(F.lit(1)).alias("count")))


def _instant(ts_col) -> F.Column:
    """A TIMESTAMP as an ISO-8601 UTC instant."""
    from cardflow.functions.text import iso_instant, utc_as_ntz
    return iso_instant(utc_as_ntz(ts_col))


def alerts_of(counts: DataFrame, threshold: int = VELOCITY_THRESHOLD) -> DataFrame:
    """Rows at or above the threshold, flattened, with the alert line (F2, K8)."""
    a = counts.where(F.col("count").isNotNull() & (F.col("count") >= threshold))
    return a.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "key", "count",
        F.format_string(VELOCITY_ALERT_TEMPLATE, F.col("key"), F.col("count"),
                        _instant(F.col("window.start")), _instant(F.col("window.end")))
        .alias("message"))


def start_velocity_alerts(records: DataFrame, sink_path: str, checkpoint: str | None = None,
                          size: str = VELOCITY_WINDOW, grace: str = VELOCITY_GRACE,
                          threshold: int = VELOCITY_THRESHOLD, trigger: dict | None = None,
                          ts: str = "event_ts") -> StreamingQuery:
    """Run the check; each micro-batch's updated alerts are written to the
    ``batch_id=<epoch>`` partition of ``sink_path`` (K8), so a replayed
    epoch rewrites its own files."""
    counts = velocity_counts(records, size, grace, ts=ts)

    def write(batch: DataFrame, epoch: int) -> None:
        append_batch(alerts_of(batch, threshold), sink_path, str(epoch))

    w = (counts.writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint or stream_checkpoint(records.sparkSession, "velocity", sink_path))
         .foreachBatch(write))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def velocity_state(spark, checkpoint: str) -> DataFrame:
    """The counts that a tumbling check keeps now (W5), read back from its
    checkpoint with the ``statestore`` source: window_start, window_end,
    key, count.  The state of the last committed micro-batch, as a restarted
    query would load it."""
    from cardflow.functions.text import utc_as_ntz
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(utc_as_ntz(F.col("key.window.start")).alias("window_start"),
                        utc_as_ntz(F.col("key.window.end")).alias("window_end"),
                        F.col("key.key").alias("key"), F.col("value.count").alias("count"))


class _StreamTime(StatefulProcessor):
    """Keeps the newest event time of one source partition."""

    def __init__(self, width: int, grace: int):
        self.width, self.grace = width, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long")

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        held = self.newest.get()
        seen = batch["us"].cummax()
        if held is not None:
            seen = seen.clip(lower=held[0])
        if len(batch):
            self.newest.update((int(seen.iloc[-1]),))
        end = batch["us"] - batch["us"] % self.width + self.width
        yield batch.assign(seen_us=seen, late=end <= seen - self.grace)[
            ["source_partition", "arrival", "key", "us", "seen_us", "late"]]

    def close(self) -> None:
        pass


def lateness(records: DataFrame, size: str = VELOCITY_WINDOW, grace: str = VELOCITY_GRACE,
             ts: str = "event_ts", key: str = "key") -> DataFrame:
    """W3 by the rule per record, as a stream: every record with ``late``
    (its window had closed, ``grace`` ago, by the newest time of its source
    partition up to its offset), as ``operators.velocity.drop_late`` gives
    it in batch: source_partition, id, key, ts, seen_max, late.

    The newest time per source partition is keyed state (a long each, in the
    RocksDB store); a micro-batch is gone through by offset, so offsets must
    come in order over micro-batches, as a topic gives them.  A task holds
    the records of its partitions in one micro-batch
    (``max_per_trigger`` bounds them).
    """
    from cardflow.functions.text import from_epoch_micros
    from cardflow.operators.velocity import _seconds
    r = records.select("source_partition", "arrival", F.col(key).alias("key"),
                       F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    marked = r.groupBy("source_partition").transformWithStateInPandas(
        _StreamTime(_seconds(size) * 1_000_000, _seconds(grace) * 1_000_000),
        "source_partition int, arrival long, key string, us long, seen_us long, late boolean", "Append", "none")
    return marked.select("source_partition", F.col("arrival").alias("id"), "key", from_epoch_micros("us").alias("ts"),
                         from_epoch_micros("seen_us").alias("seen_max"), "late")


def start_lateness(records: DataFrame, sink_path: str, checkpoint: str | None = None,
                   size: str = VELOCITY_WINDOW, grace: str = VELOCITY_GRACE,
                   trigger: dict | None = None, ts: str = "event_ts") -> StreamingQuery:
    """Run ``lateness``; a micro-batch's records go to its folder of ``sink_path``."""
    def write(batch: DataFrame, epoch: int) -> None:
        append_batch(batch, sink_path, str(epoch))

    ck = checkpoint or stream_checkpoint(records.sparkSession, "lateness", sink_path)
    w = lateness(records, size, grace, ts).writeStream.outputMode("append").option("checkpointLocation", ck).foreachBatch(write)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def _trailing_in_span(width: int):
    """Per span of a card: the number of its records, and of those of the span
    before, in ``[t - width, t]`` for each time t of the span.  Times are
    distinct, in any order, with the number of records at each."""
    @F.pandas_udf("array<bigint>")
    def counts(own: pd.Series, own_n: pd.Series, before: pd.Series, before_n: pd.Series) -> pd.Series:
        def one(t, n, t0, n0):
            all_t, all_n = (np.asarray(t), np.asarray(n)) if t0 is None else (np.concatenate([t0, t]), np.concatenate([n0, n]))
            order = np.argsort(all_t, kind="stable")
            at, upto = all_t[order], np.concatenate([[0], np.cumsum(all_n[order])])
            t = np.asarray(t)
            return upto[np.searchsorted(at, t, "right")] - upto[np.searchsorted(at, t - width, "left")]

        return pd.Series([one(*x) for x in zip(own, own_n, before, before_n)], dtype=object)

    return counts


def trailing_counts(records: DataFrame, size: str = VELOCITY_WINDOW, grace: str = VELOCITY_GRACE,
                    ts: str = "event_ts", key: str = "key") -> DataFrame:
    """W2 as a stream-stream join: for each record the number of records of
    its card in ``[t - size, t]``, itself included.

    Records are put together by (card, time), which drops those behind the
    watermark, and then by (card, span of ``size``).  A span is joined with
    the one before it, and its records are counted by rank in both: linear
    in the records up to the sort, however many a card has in a span, where a
    join of records with records meets every pair.  A span's list is what a
    task holds at once: a card that holds a third of all records is spread
    over its spans.

    Both sides are the one stream; the watermark and the interval tell the
    engine how long a span can still meet another, so it keeps and expires
    the state by itself, under the query's checkpoint.  A record is (source
    partition, offset), so equal offsets of two partitions and records of
    one microsecond stay apart.  Counts are final: a record's comes out
    once, when the watermark (the newest time less ``grace``) has passed its
    span.
    """
    from cardflow.operators.velocity import _seconds
    width = _seconds(size)
    r = records.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, grace).where(F.col(ts).isNotNull())

    def spans(at_time: F.Column, name: str) -> DataFrame:
        at = r.groupBy(F.col(ts).alias("ts"), F.col(key).alias("key")).agg(at_time.alias("what"))
        return (at.groupBy(F.window("ts", f"{width} seconds").alias("w"), "key")
                .agg(F.collect_list(F.struct(F.unix_micros("ts").alias("us"), "what")).alias(name))
                .withColumn("until", F.window_time("w")))

    one = (spans(F.collect_list(F.struct("source_partition", F.col("arrival").alias("id"))), "own")
           .select("key", "until", "own", F.unix_seconds("w.start").alias("begin")))
    other = (spans(F.count(F.lit(1)), "before")
             .select(F.col("key").alias("other_key"), F.col("until").alias("other_until"), "before",
                     F.unix_seconds("w.end").alias("other_end")))
    pairs = one.join(other, F.expr(
        f"key <=> other_key AND begin = other_end AND other_until >= until - INTERVAL {width} SECONDS AND other_until <= until"),
        "left")
    count = _trailing_in_span(width * 1_000_000)(
        F.col("own.us"), F.transform("own", lambda x: F.size(x["what"]).cast("long")), F.col("before.us"), F.col("before.what"))
    times = pairs.withColumn("count", count).select("key", F.inline(F.arrays_zip(F.col("own.us").alias("us"), F.col("own.what").alias("what"), "count")))
    return (times.select("key", "us", "count", F.inline("what"))
            .select("source_partition", "id", "key", F.timestamp_micros("us").alias("ts"), F.col("count").alias("trailing_count")))


def start_trailing_counts(records: DataFrame, sink_path: str, checkpoint: str | None = None,
                          size: str = VELOCITY_WINDOW, grace: str = VELOCITY_GRACE,
                          threshold: int = VELOCITY_THRESHOLD, trigger: dict | None = None,
                          ts: str = "event_ts") -> StreamingQuery:
    """Run ``trailing_counts``: every record with ``threshold`` or more of
    its card in the trailing ``size``, once, with its final count.  Records
    later than ``grace`` behind the newest of earlier batches are dropped."""
    from cardflow.functions.text import utc_as_ntz
    counts = trailing_counts(records, size, grace, ts).where(F.col("trailing_count") >= threshold)

    def write(batch: DataFrame, epoch: int) -> None:
        append_batch(batch.withColumn("ts", utc_as_ntz("ts")), sink_path, str(epoch))

    ck = checkpoint or stream_checkpoint(records.sparkSession, "trailing-counts", sink_path)
    w = counts.writeStream.outputMode("append").option("checkpointLocation", ck).foreachBatch(write)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def trailing_batch(batch: DataFrame, state_path: str, sink_path: str, epoch: int,
                   size: str = VELOCITY_WINDOW, grace: str = VELOCITY_GRACE,
                   threshold: int = VELOCITY_THRESHOLD, ts: str = "event_ts",
                   key: str = "key", id_col: str = "id", part_col: str = "source_partition") -> None:
    """One micro-batch of the trailing check with early counts.

    A record is (``part_col``, ``id_col``) of its card (without a
    ``part_col`` in the batch, one partition).  The state is a table per epoch: the records of the last ``size + grace``
    with the count each had.  A batch is counted together with them, and
    every record whose count rose is emitted if it is at the threshold, also
    a retained one whose window an out-of-order record joins; so a record's
    highest emitted count is that of the batch operator over all records.
    A record later than ``grace`` behind the newest one of earlier batches
    is not counted but written to the sink's ``late`` folder: the state it
    would need is gone.  A replayed epoch reads the previous epoch's state
    and rewrites its own outputs; states before that are deleted.
    """
    from cardflow.functions.text import utc_as_ntz
    from cardflow.operators.velocity import _seconds, velocity_trailing
    from cardflow.session import delete_path, materialize, path_exists
    spark = batch.sparkSession
    t = F.col(ts)
    if dict(batch.dtypes).get(ts) == "timestamp":
        t = utc_as_ntz(t)
    part = F.col(part_col) if part_col in batch.columns else F.lit(0)
    record = ["source_partition", "id", "key", "ts"]
    cols = [part.cast("int").alias("source_partition"), F.col(id_col).alias("id"), F.col(key).alias("key"),
            t.cast("timestamp_ntz").alias("ts")]
    state = lambda n: f"{state_path.rstrip('/')}/epoch={n}"
    new = materialize(batch.select(*cols), f"trailing-{epoch}")  # the source is read once
    old = spark.read.parquet(state(epoch - 1)) if epoch > 0 and path_exists(spark, state(epoch - 1)) else None
    seen = old.agg(F.max("ts")).first()[0] if old is not None else None  # one value
    late = F.lit(False) if seen is None else F.col("ts") < ntz_lit(seen) - F.expr(f"INTERVAL {_seconds(grace)} SECONDS")
    append_batch(new.where(late), f"{sink_path.rstrip('/')}_late", str(epoch))
    new = new.where(~late)
    both = new if old is None else new.unionByName(old.select(*record))
    one = both.withColumn("record", F.struct("source_partition", "id"))
    counted = velocity_trailing(one, id_col="record", size=size, threshold=1) \
        .select("id.source_partition", F.col("id.id").alias("id"), "key", "ts", "trailing_count")
    if old is None:
        counted = counted.withColumn("before", F.lit(0).cast("bigint"))
    else:
        was = old.select(*[F.col(c).alias(f"was_{c}") for c in record], F.col("trailing_count").alias("before"))
        same = [F.col(c).eqNullSafe(F.col(f"was_{c}")) for c in record]
        counted = counted.join(was, same, "left").drop(*[f"was_{c}" for c in record])
    counted = materialize(counted.withColumn("before", F.coalesce("before", F.lit(0))), f"trailing-counts-{epoch}")
    append_batch(counted.where((F.col("trailing_count") > F.col("before")) & (F.col("trailing_count") >= threshold))
                 .drop("before"), sink_path, str(epoch))
    newest = counted.agg(F.max("ts")).first()[0]  # one value
    horizon = _seconds(size) + _seconds(grace)
    kept = counted if newest is None else counted.where(
        F.col("ts") >= ntz_lit(newest) - F.expr(f"INTERVAL {horizon} SECONDS"))
    kept.select(*record, F.greatest("trailing_count", "before").alias("trailing_count")) \
        .write.mode("overwrite").parquet(state(epoch))
    if epoch > 1:
        delete_path(spark, state(epoch - 2))


def start_velocity_trailing(records: DataFrame, sink_path: str, state_path: str,
                            checkpoint: str | None = None,
                            size: str = VELOCITY_WINDOW, grace: str = VELOCITY_GRACE,
                            threshold: int = VELOCITY_THRESHOLD, trigger: dict | None = None,
                            ts: str = "event_ts", id_col: str = "arrival") -> StreamingQuery:
    """Run W2 with early counts: every record with ``threshold`` or more of
    its card in the trailing ``size`` so far (the documented "3+ in the last
    30 seconds" contract), again when an out-of-order record lifts it.
    ``start_trailing_counts`` emits each record once, with its final count."""
    def write(batch: DataFrame, epoch: int) -> None:
        trailing_batch(batch, state_path, sink_path, epoch, size, grace, threshold, ts=ts,
                       id_col=id_col)

    ck = checkpoint or stream_checkpoint(records.sparkSession, "velocity-trailing", sink_path)
    w = records.writeStream.option("checkpointLocation", ck).foreachBatch(write)
    return w.trigger(**(trigger or {"availableNow": True})).start()
