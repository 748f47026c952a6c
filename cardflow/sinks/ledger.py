"""The ledger as sorted runs.

A batch adds one run of new rows, sorted by key (level 0).  When ``FAN`` runs of
a level have come together, ``compact`` merges them into one of the next level,
in ``LEDGER_BUCKETS`` folders by a hash of the key, sorted by key, with Parquet
Bloom filters on it; a commit swaps old for new.  So a row is rewritten once a
level, there are at most ``FAN`` runs a level however many batches came, and a
lookup opens one folder a run and reads a row group only if its Bloom filter
and its least and greatest key allow the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.schemas import LEDGER_TABLE, TRANSACTION, TRANSACTION_COLUMNS
from cardflow.session import child_folders, delete_path
from cardflow.sinks.commits import Batch, CommitLog, State
from cardflow.sinks.writers import LEDGER_BUCKETS, key_bucket

KEY = "idempotencyKey"
NEW, RUNS = "ledger", "ledger_runs"
SINCE = "rows_since"  # runs of level 0 that no snapshot covers yet
FAN = 8
ROW_GROUP = 16 << 20


def _options(rows_per_group: int = 100_000) -> dict:
    return {f"parquet.bloom.filter.enabled#{KEY}": "true", f"parquet.bloom.filter.expected.ndv#{KEY}": str(rows_per_group),
            "parquet.block.size": str(ROW_GROUP)}


def add_rows(batch: Batch, new_rows: DataFrame) -> DataFrame:
    """The batch's new rows as a run of level 0; the written rows.  They are
    also rows since the last snapshot, whatever becomes of the run."""
    rows = batch.write(new_rows.repartitionByRange(KEY).sortWithinPartitions(KEY), NEW, _options())
    batch.name(SINCE, batch.folder_of(NEW))
    return rows


def rows_since(log: CommitLog, state: State) -> DataFrame:
    """The rows of batches after the last snapshot."""
    paths = [f.path for f in state.folders(SINCE)]
    return log.spark.read.schema(TRANSACTION).parquet(*paths) if paths else log.spark.createDataFrame([], TRANSACTION)


def read_rows(log: CommitLog, state: State | None = None) -> DataFrame | None:
    """All committed ledger rows with their ``batch_id`` (those of merged
    runs: of the merge); None before the first batch."""
    state = state or log.state()
    found = [df.select(*TRANSACTION_COLUMNS, "batch_id") for df in (
        log.read(NEW, _typed(), state=state),
        log.read(RUNS, LEDGER_TABLE, state=state)) if df is not None]
    if not found:
        return None
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _typed():
    from pyspark.sql import types as T
    return T.StructType(TRANSACTION.fields + [T.StructField("batch_id", T.StringType(), True)])


def find(log: CommitLog, key: str, buckets: int = LEDGER_BUCKETS) -> DataFrame | None:
    """The stored row of one key (S4): zero or one row (``buckets`` as the
    runs were merged).  Bucket and key are
    constants of the plan, so the scan prunes folders by the one and skips
    row groups by the other."""
    state = log.state()
    same = F.col(KEY) == F.lit(key)
    new, runs = log.read(NEW, _typed(), state=state), log.read(RUNS, LEDGER_TABLE, state=state)
    found = [df.select(*TRANSACTION_COLUMNS) for df in (
        None if new is None else new.where(same),
        None if runs is None else runs.where((F.col("key_bucket") == key_bucket(F.lit(key), buckets)) & same)) if df is not None]
    if not found:
        return None
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def compact(log: CommitLog, fan: int = FAN, buckets: int = LEDGER_BUCKETS) -> int:
    """Merge every level that has ``fan`` runs; the number of merges."""
    merges = 0
    while True:
        state = log.state()
        levels: dict[int, list] = {}
        for f in state.folders(NEW) + state.folders(RUNS):
            levels.setdefault(f.level, []).append(f)
        full = [(level, fs) for level, fs in sorted(levels.items()) if len(fs) >= fan]
        if not full:
            return merges
        level, old = full[0]
        batch = log.begin(f"merge-{state.seq + 1}")
        table = NEW if level == 0 else RUNS
        rows = (log.spark.read.schema(_typed() if level == 0 else LEDGER_TABLE).option("basePath", log.place(table))
                .parquet(*[f.path for f in old]).select(*TRANSACTION_COLUMNS))
        (rows.withColumn("key_bucket", key_bucket(F.col(KEY), buckets)).hint("rebalance", "key_bucket")
         .sortWithinPartitions("key_bucket", KEY)
         .write.mode("overwrite").options(**_options()).partitionBy("key_bucket").parquet(batch.folder(RUNS, level + 1)))
        batch.remove(table, old)
        batch.commit({"level": level + 1, "merged": len(old)})
        merges += 1


def vacuum(log: CommitLog, tables: tuple = (NEW, RUNS)) -> int:
    """Delete the folders of ``tables`` that no commit names (merged runs,
    abandoned attempts) once nobody reads an older state; their number."""
    state, gone = log.state(), 0
    live = {f.path for fs in state.tables.values() for f in fs}
    for table in tables:
        for b in child_folders(log.spark, log.place(table)):
            for a in child_folders(log.spark, f"{log.place(table)}/{b}"):
                path = f"{log.place(table)}/{b}/{a}"
                if a.startswith("attempt=") and path not in live:
                    delete_path(log.spark, path)
                    gone += 1
    return gone
