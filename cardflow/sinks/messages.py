"""Outbound messages (K4, K5): their columns, and the queue and topic sinks
that the readers of S2 and S3 read (a JSON folder, or a broker)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardflow.functions.text import encode_json, ntz_as_utc
from cardflow.session import child_folders, delete_path, materialize
from cardflow.sinks.writers import append_batch

TOPIC_PARTITIONS = 4
# Batches whose offsets a folder topic remembers: as far back as one can be replayed.
KEPT_BATCHES = 100


def topic_partition(key, partitions: int = TOPIC_PARTITIONS):
    """Partition of a record's key, any text: the first 32 bits of its MD5
    modulo the number of partitions (a null key: partition 0)."""
    head = F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 8), 16, 10).cast("long")
    return F.when(key.isNull(), F.lit(0)).otherwise(F.pmod(head, F.lit(partitions))).cast("int")


def fraud_messages(stored: DataFrame) -> DataFrame:
    """Fraud-check queue messages: JSON body plus a numeric ``amount``
    attribute (K4).  One per stored (new) transaction."""
    return stored.select("transactionId", encode_json().alias("body"), "amount")


def topic_records(stored: DataFrame, partitions_from: str = "maskedPan",
                  partitions: int = TOPIC_PARTITIONS) -> DataFrame:
    """Transaction topic records keyed by masked card number (K5).

    ``timestamp`` is the event time; ``source_partition`` follows the key
    so one card's records stay in one partition, in order.
    """
    return stored.select(
        F.col("maskedPan").alias("key"), encode_json().alias("value"),
        F.col("createdAt").alias("timestamp"),
        topic_partition(F.col(partitions_from), partitions).alias("source_partition"),
    )


def publish_queue(stored: DataFrame, target: str, batch_id: str, fmt: str = "json",
                  topic: str = "fraud-check") -> None:
    """Send a fraud-check message per stored row where ``read_fraud_queue``
    reads it: the batch's folder below ``target``, or, with ``fmt="kafka"``,
    the broker at ``target`` (the amount as a header)."""
    amount = F.col("amount").cast("string")
    if fmt == "kafka":
        header = F.struct(F.lit("amount").alias("key"), F.encode(amount, "UTF-8").alias("value"))
        _send(fraud_messages(stored).select(F.col("transactionId").alias("key"), F.col("body").alias("value"),
                                            F.array(header).alias("headers")), target, topic)
    else:
        append_batch(stored.select(encode_json().alias("body"), amount.alias("amount"),
                                   ntz_as_utc("createdAt").alias("sent_at")), target, batch_id, fmt)


def publish_topic(stored: DataFrame, target: str, batch_id: str, fmt: str = "json",
                  topic: str = "transactions.authorized", partitions: int = TOPIC_PARTITIONS) -> None:
    """Send a topic record per stored row where ``read_topic`` reads it: the
    batch's folder below ``target``, or, with ``fmt="kafka"``, the broker at
    ``target``, which partitions by key.

    In the folder a record's ``arrival`` is its offset: records of a source
    partition are numbered without gaps, from 0, over all batches (within a
    batch by event time), so (source_partition, arrival) identifies a record
    as on a broker.  A replayed batch gets the offsets it had; one writer per
    folder.
    """
    rec = topic_records(stored, partitions=partitions)
    if fmt == "kafka":
        _send(rec.select("key", "value", ntz_as_utc("timestamp").alias("timestamp")), target, topic)
    else:
        out = rec.select("key", "value", ntz_as_utc("timestamp").alias("timestamp"), "source_partition")
        append_batch(with_offsets(out, offsets_path(target), batch_id), target, batch_id, fmt)


def offsets_path(target: str) -> str:
    """Where a folder topic keeps the offsets its batches got."""
    return f"{target.rstrip('/')}_offsets"


def with_offsets(records: DataFrame, path: str, batch_id: str) -> DataFrame:
    """``records`` with their offset as ``arrival`` (see ``publish_topic``).

    Records are sorted by range over (partition, time, content), so the
    numbers of a partition come from as many tasks as hold it: a record's
    place in its task's run of the partition, plus what the runs and the
    batches before hold, which are a row each.  The offsets of the last
    ``KEPT_BATCHES`` batches are kept at ``path``, a folder per batch in
    order.
    """
    spark = records.sparkSession
    order = ["source_partition", "timestamp", "key", "value"]
    run = F.shiftright("_row", 33)
    placed = materialize(records.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_row", F.monotonically_increasing_id()).withColumn("_run", run), "topic-records")
    runs = placed.groupBy("source_partition", "_run").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("source_partition").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    begin = _batch_offsets(spark, path, batch_id, runs)
    starts = (runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(begin, "source_partition")
              .select("source_partition", "_run", (F.col("begin") + F.col("_before") - F.col("_first")).alias("_shift")))
    return (placed.join(starts, ["source_partition", "_run"])
            .select("key", "value", "timestamp", "source_partition", (F.col("_row") + F.col("_shift")).alias("arrival")))


def _batch_offsets(spark, path: str, batch_id: str, runs: DataFrame) -> DataFrame:
    """The first offset of each source partition in this batch, as written
    by it before or following the batch before it; written if new."""
    schema = "source_partition int, begin long, end long, batch_id string"
    kept = sorted(child_folders(spark, path))
    before = spark.sql("SELECT CAST(NULL AS INT) AS source_partition, CAST(NULL AS BIGINT) AS begin, "
                       "CAST(NULL AS BIGINT) AS end, '' AS batch_id, '' AS n WHERE false")
    if kept:
        before = spark.read.schema(schema + ", n string").option("basePath", path).parquet(
            *[f"{path}/{k}" for k in kept[-KEPT_BATCHES:]])
        mine = before.where(F.col("batch_id") == batch_id)
        if mine.limit(1).count():
            return mine.select("source_partition", "begin")
    last = before.where(F.concat(F.lit("n="), F.col("n")) == (kept[-1] if kept else ""))
    sizes = runs.groupBy("source_partition").agg(F.sum("_n").alias("size"))
    now = (last.select("source_partition", F.col("end").alias("begin")).join(sizes, "source_partition", "full")
           .select("source_partition", F.coalesce("begin", F.lit(0).cast("long")).alias("begin"),
                   F.coalesce("size", F.lit(0).cast("long")).alias("size"))
           .select("source_partition", "begin", (F.col("begin") + F.col("size")).alias("end"), F.lit(batch_id).alias("batch_id")))
    number = int(kept[-1].removeprefix("n=")) + 1 if kept else 0
    folder = f"{path}/n={number:012d}"
    now.coalesce(1).write.mode("overwrite").parquet(folder)
    for old in kept[:-KEPT_BATCHES]:
        delete_path(spark, f"{path}/{old}")
    return spark.read.schema(schema).parquet(folder).select("source_partition", "begin")


def _send(df: DataFrame, servers: str, topic: str) -> None:
    (df.write.format("kafka").option("kafka.bootstrap.servers", servers)
     .option("topic", topic).option("includeHeaders", "true").save())
