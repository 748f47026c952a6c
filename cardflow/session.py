"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Session settings every job relies on: UTC wall clock (windows and epoch
# conversions), ANSI arithmetic (a bad cast fails instead of yielding NULL,
# so lenient parsing is always an explicit try_cast), and AQE for runtime
# coalescing, broadcast decisions from measured sizes, and skew splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # state changes are logged per micro-batch (a changelog), snapshots taken
    # in the background: durable keyed state without full uploads each batch
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app_name: str = "cardflow",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    On a cluster ``master`` stays None (spark-submit decides) and
    ``shuffle_partitions`` should be sized so a shuffle partition is a
    few hundred MB; AQE then coalesces small ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set the SQL settings above on an existing session (e.g. the driver's)."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql.") and "stateStore.providerClass" not in k:
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a running session
                pass


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The cluster sets it; tests set it when it is unset.  A machine-local
    temporary folder is never chosen here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job's state."""
    return os.path.join(checkpoint_root(spark), "cardflow", f"{name}-{uuid.uuid4().hex[:12]}")


# The deployment's card-number key (16, 24 or 32 bytes).
PAN_KEY_CONF = "spark.cardflow.panKey"


def pan_key(spark: SparkSession):
    """The card-number encryption key as a Column, read from the session; an
    error when the session names none.

    The key's text is added to ``spark.sql.redaction.string.regex``, so
    plans printed by explain show it redacted.
    """
    import re
    from pyspark.sql import functions as F
    key = spark.conf.get(PAN_KEY_CONF, None)
    if not key:
        raise RuntimeError(f"{PAN_KEY_CONF} is not set; encryption needs a key")
    pattern = re.escape(key)
    current = spark.conf.get("spark.sql.redaction.string.regex", None)
    if not current:
        spark.conf.set("spark.sql.redaction.string.regex", pattern)
    elif pattern not in current.split("|"):
        spark.conf.set("spark.sql.redaction.string.regex", f"{current}|{pattern}")
    return F.lit(key)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on its filesystem (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on its filesystem, if it exists."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` (none if it does not exist)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()]


def path_version(spark: SparkSession, path: str) -> tuple | None:
    """What a file or folder holds now: its files' number, total size and
    latest modification at its top, in two calls however many files there
    are; None if it does not exist."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    size = fs.getContentSummary(p)
    return size.getFileCount(), size.getLength(), fs.getFileStatus(p).getModificationTime()


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    return a DataFrame reading it: cuts lineage in one pass, survives lost
    executors, and reads back with pruning and pushdown.  Zstandard: ids and
    hashes are hexadecimal text, which the default codec leaves at full size."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def stream_checkpoint(spark: SparkSession, name: str, sink: str) -> str:
    """A stable checkpoint folder for a stream writing to ``sink``, under the
    shared ``spark.checkpoint.dir``: a restarted query finds its offsets and
    state again."""
    import hashlib
    digest = hashlib.sha1(sink.encode()).hexdigest()[:16]
    return os.path.join(checkpoint_root(spark), "cardflow", "streams", f"{name}-{digest}")
