"""Sources with explicit schemas.

File sources stand in for the broker ones: the same columns come out of a
JSON landing folder as out of Kafka (``key``, ``value``, ``timestamp``),
so a stream can be replayed from files in tests and read from a broker in
production (``fmt="kafka"`` when the connector is on the classpath).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardflow.functions.text import decode_json, ntz_as_utc, with_decoded
from cardflow.schemas import REQUEST, TOPIC_RECORD, TRANSACTION_JSON

# Request body as sent: five strings (arrival and request_id are added
# by the landing process).
REQUEST_BODY = T.StructType([f for f in REQUEST.fields])

QUEUE_MESSAGE = T.StructType([
    T.StructField("body", T.StringType(), True),
    T.StructField("amount", T.StringType(), True),
    T.StructField("sent_at", T.TimestampType(), True),
])


def read_requests(spark: SparkSession, path: str, streaming: bool = False,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Authorization requests from JSON files, every field as text."""
    if streaming:
        r = spark.readStream.schema(REQUEST_BODY)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.json(path)
    return spark.read.schema(REQUEST_BODY).json(path)


def read_topic(spark: SparkSession, source: str, fmt: str = "json",
               event_time: str = "timestamp", topic: str = "transactions.authorized",
               streaming: bool = True, max_per_trigger: int | None = None) -> DataFrame:
    """Transaction topic records, earliest first.

    ``event_time="timestamp"`` uses the record timestamp, as the velocity
    check does; ``"createdAt"`` takes the payload's creation time instead
    (for replays).  Output adds ``event_ts`` (TIMESTAMP, as watermarks need).
    """
    if fmt == "kafka":
        r = spark.readStream if streaming else spark.read
        if max_per_trigger and streaming:
            r = r.option("maxOffsetsPerTrigger", max_per_trigger)
        df = _kafka(r, source, topic).select(
            F.col("key").cast("string"), F.col("value").cast("string"), "timestamp",
            F.col("partition").alias("source_partition"), F.col("offset").alias("arrival"))
    else:
        r = spark.readStream if streaming else spark.read
        r = r.schema(TOPIC_RECORD)
        if max_per_trigger and streaming:
            r = r.option("maxFilesPerTrigger", max_per_trigger)
        df = r.option("recursiveFileLookup", "true").json(source)
    if event_time == "createdAt":
        ts = ntz_as_utc(decode_json(F.col("value")).getField("createdAt"))
    else:
        ts = F.col("timestamp").cast("timestamp")
    return df.withColumn("event_ts", ts)


def _kafka(reader, source: str, topic: str):
    """A Kafka reader; a clear error when the connector is not installed."""
    try:
        return (reader.format("kafka").option("kafka.bootstrap.servers", source)
                .option("subscribe", topic).option("startingOffsets", "earliest").load())
    except Exception as e:  # the data source is resolved on load
        if "kafka" in str(e).lower() and ("not found" in str(e).lower()
                                          or "failed to find" in str(e).lower()):
            raise RuntimeError("the Kafka source needs the spark-sql-kafka package on the "
                               "classpath; use fmt='json' for a folder source") from e
        raise


def read_fraud_queue(spark: SparkSession, path: str, max_per_trigger: int | None = None,
                     streaming: bool = True, fmt: str = "json",
                     topic: str = "fraud-check") -> DataFrame:
    """Fraud-check messages (S3): body text plus the amount attribute.

    ``max_per_trigger`` bounds each micro-batch where wanted
    (``maxFilesPerTrigger`` for a folder, ``maxOffsetsPerTrigger`` on a
    broker, where ``path`` is the bootstrap servers); a trigger interval
    sets the cadence.  A broker's messages carry the amount in their body
    and, as sent by ``sinks.messages``, in an ``amount`` header.
    """
    if fmt == "kafka":
        r = spark.readStream if streaming else spark.read
        if streaming and max_per_trigger:
            r = r.option("maxOffsetsPerTrigger", max_per_trigger)
        raw = _kafka(r.option("includeHeaders", "true"), path, topic)
        header = F.filter("headers", lambda h: h["key"] == F.lit("amount"))[0]["value"].cast("string")
        sent = F.get_json_object(F.col("value").cast("string"), "$.amount")
        return raw.select(F.col("value").cast("string").alias("body"),
                          F.coalesce(header, sent).alias("amount"),
                          F.col("timestamp").alias("sent_at"))
    if not streaming:
        return spark.read.schema(QUEUE_MESSAGE).option("recursiveFileLookup", "true").json(path)
    r = spark.readStream.schema(QUEUE_MESSAGE).option("recursiveFileLookup", "true")
    if max_per_trigger:
        r = r.option("maxFilesPerTrigger", max_per_trigger)
    return r.json(path)


def read_receipts(spark: SparkSession, path: str, receipt_key: str | None = None) -> DataFrame:
    """Receipts written by ``write_receipts`` back as rows (S6): the
    decoded transaction columns plus the raw document text in ``value``.

    With a ``receipt_key`` (``receipts/<merchant>/<transaction>.json``) only
    the merchant's bucket is read, and only documents that hold the
    transaction's id are decoded; zero or one row.
    """
    from cardflow.functions.text import receipt_key as key_of
    from cardflow.sinks.writers import receipt_bucket
    raw = spark.read.schema("value string, batch_id string, merchant_bucket int").text(path)
    if receipt_key is not None:
        merchant, _, name = receipt_key.removeprefix("receipts/").rpartition("/")
        bucket = spark.range(1).select(receipt_bucket(F.lit(merchant))).first()[0]
        raw = raw.where((F.col("merchant_bucket") == bucket) & F.contains("value", F.lit(name.removesuffix(".json"))))
    # the batch and bucket of the path are not kept: the document holds the rest
    rows = with_decoded(raw.select("value"), "value").select("t.*", "value")
    return rows if receipt_key is None else rows.where(key_of("merchantId", "transactionId") == receipt_key)


def find_receipt(spark: SparkSession, index: str | list[str], key: str) -> DataFrame | None:
    """The receipt of one key by the index of ``write_receipt_index`` (one
    folder, or one per batch): the index is asked for the key alone, and the
    one file it names is opened.  None if there is no such receipt."""
    from cardflow.functions.text import receipt_key as key_of
    folders = [index] if isinstance(index, str) else index
    if not folders:
        return None
    at = (spark.read.schema("receiptKey string, file string").parquet(*folders)
          .where(F.col("receiptKey") == F.lit(key)).select("file").first())
    if at is None:
        return None
    rows = with_decoded(spark.read.schema("value string").text(at["file"]), "value").select("t.*", "value")
    return rows.where(key_of("merchantId", "transactionId") == F.lit(key))


def parse_messages(messages: DataFrame) -> DataFrame:
    """Messages with their decoded transaction in ``t`` (Q2): written once,
    it serves every output of a micro-batch."""
    return with_decoded(messages, "body")


def decode_messages(messages: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split queue messages into (decoded transactions, dead letters) (Q2).

    A body that is not a JSON object of the transaction shape goes to the
    dead-letter output with its raw text; its neighbours are processed.
    """
    parsed = messages if "t" in messages.columns else parse_messages(messages)
    good_row = F.col("t").isNotNull() & F.col("t.idempotencyKey").isNotNull() & \
        F.col("t.transactionId").isNotNull()
    extra = [c for c in (keep or []) if c in messages.columns]
    good = parsed.where(good_row).select("t.*", *extra)
    dead = parsed.where(~good_row | F.col("t").isNull()).select(
        "body", F.lit("unparsable message body").alias("reason"))
    return good, dead


__all__ = ["read_requests", "read_topic", "read_fraud_queue", "read_receipts",
           "decode_messages", "TRANSACTION_JSON"]


def read_by_status(spark: SparkSession, path: str, status: str) -> DataFrame:
    """Rows of one status from a status snapshot (S5), oldest first; only
    that status's folder is read."""
    from cardflow.schemas import TRANSACTION
    df = spark.read.schema(TRANSACTION).parquet(path)
    return df.where(F.col("status") == F.lit(status)).orderBy("createdAt", "idempotencyKey")
