"""File sinks: ledger, receipts, settlement summaries, alerts (K1-K3, K6, K8).

Every writer is idempotent under replay: output for one batch goes to its
own ``batch_id=<id>`` folder, which a rerun (after a lost executor or a
restarted stream) overwrites whole, so no file of an earlier attempt stays,
also where the rerun yields fewer rows or none.  No session setting changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.functions.text import encode_json, receipt_key
from cardflow.session import materialize


def batch_folder(path: str, batch_id: str) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def append_batch(df: DataFrame, path: str, batch_id: str, fmt: str = "parquet") -> None:
    """Write ``df`` as the ``batch_id`` folder of the table at ``path`` (K1).
    Text formats keep a time's microseconds (by default they cut it to
    milliseconds)."""
    (df.write.mode("overwrite").format(fmt).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
     .save(batch_folder(path, batch_id)))


# Key buckets of the ledger: a batch reads only the buckets its keys fall in.
LEDGER_BUCKETS = 256
# Merchant buckets of the receipts: a fixed number, however many merchants.
RECEIPT_BUCKETS = 64


def key_bucket(key_col, buckets: int = LEDGER_BUCKETS):
    return F.pmod(F.xxhash64(key_col), F.lit(buckets)).cast("int")


def write_ledger(new_rows: DataFrame, path: str, batch_id: str,
                 buckets: int = LEDGER_BUCKETS) -> None:
    """Store a batch's new transactions (K1: insert of absent keys only;
    the anti-join against earlier batches happened in ``authorize``).

    The batch's folder holds a folder per key bucket; rows are gathered by
    bucket first, so a bucket is a few files however many tasks there are,
    and a later batch can read just the buckets of its keys
    (``read_ledger_for``).
    """
    (new_rows.withColumn("key_bucket", key_bucket(F.col("idempotencyKey"), buckets))
     .hint("rebalance", "key_bucket")
     .write.mode("overwrite").partitionBy("key_bucket").parquet(batch_folder(path, batch_id)))


def read_ledger_for(spark, path: str, keys: DataFrame, buckets: int = LEDGER_BUCKETS):
    """The ledger rows that can match ``keys`` (column idempotencyKey):
    only the folders of the buckets those keys hash to are read.  The
    bucket list has at most ``buckets`` entries."""
    wanted = [r[0] for r in keys.select(key_bucket(F.col("idempotencyKey"), buckets).alias("b"))
              .distinct().collect()]
    return read_ledger(spark, path).where(F.col("key_bucket").isin(wanted))


def read_ledger(spark, path: str) -> DataFrame:
    """The whole ledger table, partition columns typed."""
    from cardflow.schemas import LEDGER_TABLE
    return spark.read.schema(LEDGER_TABLE).parquet(path)


def receipt_bucket(merchant_col, buckets: int = RECEIPT_BUCKETS):
    return F.pmod(F.xxhash64(merchant_col), F.lit(buckets)).cast("int")


def write_receipts(stored: DataFrame, path: str, batch_id: str, folder: str | None = None) -> None:
    """One JSON document per transaction, grouped by merchant bucket (K2).

    Many receipts per file, not one object per row, and a fixed number of
    folders per batch; the ``receiptKey`` stays a computed column, and
    ``readers.read_receipts`` finds a receipt by it in one bucket.
    ``folder`` names the batch's folder where it is not the usual one.
    """
    (stored.select(encode_json().alias("value"), receipt_bucket(F.col("merchantId")).alias("merchant_bucket"))
     .hint("rebalance", "merchant_bucket")
     .write.mode("overwrite").partitionBy("merchant_bucket").text(folder or batch_folder(path, batch_id)))


def write_receipt_index(spark, receipts: str, index: str) -> None:
    """The index of written receipts (S6): receiptKey and the file that holds
    it, made from the files themselves (``_metadata.file_path``), sorted by
    key with a Bloom filter on it.  ``receipts``: a batch's receipt folder."""
    raw = spark.read.schema("value string").text(receipts)
    (raw.select(F.col("_metadata.file_path").alias("file"), F.json_tuple("value", "merchantId", "transactionId").alias("merchant", "id"))
     .select(receipt_key("merchant", "id").alias("receiptKey"), "file")
     .repartitionByRange("receiptKey").sortWithinPartitions("receiptKey")
     .write.mode("overwrite").option("parquet.bloom.filter.enabled#receiptKey", "true").parquet(index))


def write_summary(current: DataFrame, path: str, batch_id: str, settled_at) -> int:
    """Settlement summary JSON plus the settled ids of one batch (K3).

    The ids are always their own dataset, sorted oldest first over all
    files; the document always names that dataset and its number of rows,
    whatever its size.  Returns the batch's count.
    """
    from cardflow.operators.settlement import settled_ids, summary_document
    base = f"{path.rstrip('/')}/{batch_id}"
    settled_ids(current, batch_id).select("transactionId", "createdAt") \
        .write.mode("overwrite").json(f"{base}/ids")
    doc = materialize(summary_document(current, batch_id, settled_at, f"{base}/ids"), "summary")
    doc.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{base}/summary")
    return doc.first()["transactionCount"]  # a single number


def write_status_snapshot(current: DataFrame, path: str) -> None:
    """Current rows as a table partitioned by status, oldest first inside
    each file: the status index as an access path.  A status query then
    reads one status folder (partition pruning).  Every task writes its own
    file per status (no shuffle by status, which would put a whole status,
    possibly most rows, in one task)."""
    (current.sortWithinPartitions("status", "createdAt", "idempotencyKey")
     .write.mode("overwrite").partitionBy("status").parquet(path))
