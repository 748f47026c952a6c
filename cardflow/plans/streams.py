"""The streams as queries: each publishes a table's rows in a few batches to
folders below the shared checkpoint folder, runs the stream over each with
``availableNow`` and one checkpoint (so every batch after the first is a
restart), and reads back what the stream wrote."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.functions.pan import mask_pan
from cardflow.functions.text import encode_json, epoch_micros, ntz_as_utc
from cardflow.session import scratch_path
from cardflow.sinks.commits import CommitLog
from cardflow.sinks.messages import offsets_path, topic_partition, with_offsets
from cardflow.sinks.writers import append_batch
from cardflow.sources.readers import read_fraud_queue, read_requests, read_topic
from cardflow.streaming.authorize import start_authorizer
from cardflow.streaming.scoring import start_scoring
from cardflow.streaming.velocity import start_trailing_counts, start_velocity_alerts

EPOCHS = 3
CLOCK = "clock"  # the key of a record that only moves the watermark


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep as many state
    partitions as the application has cores (they cannot change later)."""
    own = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        own.conf.set(k, spark.conf.get(k))
    own.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return own


def by_time(df: DataFrame, ts: str, parts: int = EPOCHS) -> list[DataFrame]:
    """``df`` cut at equal spans of its time, in order."""
    us = epoch_micros(ts)
    low, high = df.agg(F.min(us), F.max(us)).first()  # two numbers
    if low is None:
        return [df]
    step = (high - low) // parts + 1
    return [df.where((us >= low + k * step) & (us < low + (k + 1) * step)) for k in range(parts)]


def topic_runs(spark: SparkSession, batches: list[DataFrame], start: Callable, wait: str) -> None:
    """Publish each batch (key, value, timestamp, source_partition) with its
    offsets and run ``start`` over the folder after each; at last a clock
    record ``wait`` after the newest, which closes what is still open."""
    topic = scratch_path(spark, "topic")
    newest = None
    for k, b in enumerate(batches):
        append_batch(with_offsets(b, offsets_path(topic), str(k)), topic, str(k), "json")
        start(read_topic(spark, topic)).awaitTermination()
        last = b.agg(F.max("timestamp").cast("timestamp_ntz")).first()[0]
        newest = max(filter(None, (newest, last)), default=None)
    if newest is not None:
        days = int(wait.split()[0])
        tick = spark.range(1).select(
            F.lit(CLOCK).alias("key"), F.lit("").alias("value"),
            ntz_as_utc(F.lit(str(newest + dt.timedelta(days=days))).cast("timestamp_ntz")).alias("timestamp"),
            F.lit(-1).alias("source_partition"), F.lit(0).cast("long").alias("arrival"))
        append_batch(tick, topic, CLOCK, "json")
        start(read_topic(spark, topic)).awaitTermination()


def trailing_stream(spark: SparkSession, requests: DataFrame, size: str, grace: str) -> DataFrame:
    """W2 as a stream over the requests' cards: source_partition, id
    (offset), key, ts, trailing_count."""
    own = stream_session(spark)
    sink = scratch_path(spark, "trailing-alerts")
    topic_runs(own, _card_batches(requests), lambda r: start_trailing_counts(r, sink, sink + "_checkpoint", size, grace),
               "30 days")
    return (spark.read.schema("source_partition int, id long, key string, ts timestamp_ntz, trailing_count long")
            .option("recursiveFileLookup", "true").parquet(sink))


def _card_batches(requests: DataFrame) -> list[DataFrame]:
    card = mask_pan("pan")
    records = requests.select(card.alias("key"), F.col("request_id").cast("string").alias("value"),
                              ntz_as_utc("arrival").alias("timestamp"), topic_partition(card).alias("source_partition"),
                              F.col("arrival").alias("ts"))
    return [b.drop("ts") for b in by_time(records, "ts")]


def tumbling_stream(spark: SparkSession, requests: DataFrame, size: str, grace: str) -> DataFrame:
    """W1, W3, W4, W6 as a stream: window_start, window_end, key and the last
    count emitted for each window."""
    own = stream_session(spark)
    sink = scratch_path(spark, "velocity-alerts")
    topic_runs(own, _card_batches(requests), lambda r: start_velocity_alerts(r, sink, sink + "_checkpoint", size, grace),
               "30 days")
    got = (spark.read.schema("window_start timestamp, window_end timestamp, key string, count long")
           .option("recursiveFileLookup", "true").parquet(sink))
    return got.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                       F.col("window_end").cast("timestamp_ntz").alias("window_end"), "key").agg(F.max("count").alias("count"))


def authorizer_stream(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """S1, K1, D1-D3 as a stream over requests landed as JSON in three
    batches: the committed outcomes."""
    own = stream_session(spark)
    land, out = scratch_path(spark, "landing"), scratch_path(spark, "authorized")
    for k, b in enumerate(by_time(requests, "arrival")):
        append_batch(b, land, str(k), "json")
        start_authorizer(read_requests(own, f"{land}/*", streaming=True), f"{out}/ledger", out, f"{out}/_checkpoint").awaitTermination()
    return CommitLog(spark, out).read("outcomes")


def scoring_stream(spark: SparkSession, stored: DataFrame, max_receives: int) -> DataFrame:
    """S3, Q1, Q2, W7 as a stream over fraud-check messages sent in three
    batches, where a transaction whose id begins with 0 also sends half a
    message: kind (score, dead), what (transaction id or
    body), riskScore, alerted, receives."""
    own = stream_session(spark)
    queue, out = scratch_path(spark, "queue"), scratch_path(spark, "scored")
    body = encode_json()
    whole = stored.select(body.alias("body"), F.col("amount").cast("string").alias("amount"),
                          ntz_as_utc("createdAt").alias("sent_at"), "createdAt", "transactionId")
    half = whole.where(F.col("transactionId").startswith("0")).withColumn("body", F.substring("body", 1, 60))
    run = lambda: start_scoring(read_fraud_queue(own, queue), out, f"{out}/_checkpoint",
                                max_receives=max_receives).awaitTermination()
    for k, b in enumerate(by_time(whole.unionByName(half), "createdAt")):
        append_batch(b.select("body", "amount", "sent_at"), queue, str(k), "json")
        run()
    for k in range(max_receives):  # later polls: what waits is received again
        append_batch(spark.range(1).select(F.lit("{}").alias("body"), F.lit(None).cast("string").alias("amount"),
                                           F.lit(None).cast("timestamp").alias("sent_at")), queue, f"poll-{k}", "json")
        run()
    read = lambda t, s: spark.read.schema(s).option("recursiveFileLookup", "true").parquet(f"{out}/{t}")
    scores = read("scores", "transactionId string, riskScore double, alerted boolean")
    dead = read("dead_letter", "body string, receives int")
    return scores.select(F.lit("score").alias("kind"), F.col("transactionId").alias("what"), "riskScore", "alerted",
                         F.lit(None).cast("int").alias("receives")).unionByName(
        dead.where("body <> '{}'").select(F.lit("dead").alias("kind"), F.col("body").alias("what"),
                                          F.lit(None).cast("double").alias("riskScore"),
                                          F.lit(None).cast("boolean").alias("alerted"), "receives"))
