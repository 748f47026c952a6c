import json
import os

from cardflow.plans.context import FIRST_CUTOFF, Pipeline
from cardflow.sinks.writers import write_receipts, write_summary
from cardflow.sources.readers import read_receipts
from tests.conftest import SF001


def test_receipts_round_trip(spark, tmp_dir):
    p = Pipeline(spark, SF001, materialize=False)
    path = os.path.join(tmp_dir, "receipts")
    write_receipts(p.stored, path, "1")
    back = read_receipts(spark, path)
    assert back.count() == 792
    assert back.drop("value").exceptAll(p.stored).count() == 0
    # a fixed number of folders, and one receipt is found in its own
    assert all(n.startswith(("merchant_bucket=", "_", ".")) for n in os.listdir(os.path.join(path, "batch_id=1")))
    row = p.stored.first()
    one = read_receipts(spark, path, f"receipts/{row.merchantId}/{row.transactionId}.json")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(merchant_bucket" in plan
    assert [r.transactionId for r in one.collect()] == [row.transactionId]
    assert read_receipts(spark, path, f"receipts/{row.merchantId}/none.json").count() == 0


def test_receipt_index_opens_one_file(spark, tmp_dir):
    from cardflow.sinks.writers import write_receipt_index
    from cardflow.sources.readers import find_receipt
    p = Pipeline(spark, SF001, materialize=False)
    folders = []
    for n, part in enumerate([p.stored.where("crc32(transactionId) % 2 = 0"), p.stored.where("crc32(transactionId) % 2 = 1")]):
        folder, index = os.path.join(tmp_dir, f"r{n}"), os.path.join(tmp_dir, f"i{n}")
        write_receipts(part, "", "", folder=folder)
        write_receipt_index(spark, f"{folder}/*", index)
        folders.append(index)
    every = spark.read.parquet(*folders)
    assert every.count() == 792 and every.select("receiptKey").distinct().count() == 792
    for row in p.stored.orderBy("transactionId").limit(3).collect():
        key = f"receipts/{row.merchantId}/{row.transactionId}.json"
        one = find_receipt(spark, folders, key)
        assert [tuple(r)[:-1] for r in one.collect()] == [tuple(row)]
        assert len(one.inputFiles()) == 1
    assert find_receipt(spark, folders, "receipts/x/y.json") is None and find_receipt(spark, [], "k") is None


def _document(base):
    files = [f for f in os.listdir(os.path.join(base, "summary")) if f.endswith(".json")]
    return json.loads(open(os.path.join(base, "summary", files[0])).read())


def test_summary_document(spark, tmp_dir):
    p = Pipeline(spark, SF001)
    n = write_summary(p.batch1_current, tmp_dir, "batch-a", FIRST_CUTOFF)
    base = os.path.join(tmp_dir, "batch-a")
    doc = _document(base)
    assert doc["transactionCount"] == doc["transactionIdsCount"] == n
    assert doc["settledAt"] == "2024-01-16T00:00:00Z" and doc["transactionIdsPath"] == f"{base}/ids"
    lines = []
    for f in sorted(x for x in os.listdir(os.path.join(base, "ids")) if x.startswith("part-")):
        lines += [json.loads(line) for line in open(os.path.join(base, "ids", f))]
    assert len(lines) == n and [x["createdAt"] for x in lines] == sorted(x["createdAt"] for x in lines)
    # an empty batch
    assert write_summary(p.batch1_current.where("false"), tmp_dir, "batch-b", FIRST_CUTOFF) == 0
    assert _document(os.path.join(tmp_dir, "batch-b"))["totalAmount"] == "0"


def test_summary_document_has_one_schema_at_every_size(spark, tmp_dir):
    rows = Pipeline(spark, SF001).batch1_current.where("status = 'AUTHORIZED'").limit(1)
    docs = []
    for n in (3, 12_000):
        many = rows.crossJoin(spark.range(n)).drop("id")
        assert write_summary(many, tmp_dir, f"n{n}", FIRST_CUTOFF) == n
        docs.append(_document(os.path.join(tmp_dir, f"n{n}")))
        assert spark.read.json(os.path.join(tmp_dir, f"n{n}", "ids")).count() == n
    assert list(docs[0]) == list(docs[1])


def test_receipts_replay_is_idempotent(spark, tmp_dir):
    p = Pipeline(spark, SF001, materialize=False)
    path = os.path.join(tmp_dir, "receipts")
    write_receipts(p.stored, path, batch_id="7")
    write_receipts(p.stored, path, batch_id="7")  # replay of the same batch
    assert read_receipts(spark, path).count() == 792


def test_ledger_read_prunes_key_buckets(spark, tmp_dir):
    from cardflow.sinks.writers import read_ledger_for, write_ledger
    p = Pipeline(spark, SF001, materialize=False)
    path = os.path.join(tmp_dir, "ledger")
    write_ledger(p.stored, path, "1")
    keys = p.stored.limit(3).select("idempotencyKey")
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        part = read_ledger_for(spark, path, keys)
        plan = part._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    # only the folders of the keys' buckets are read
    filters = [line[line.index("PartitionFilters"):] for line in plan.split("\n")
               if "PartitionFilters" in line]
    assert filters and "key_bucket" in filters[0].split("]")[0] and " IN (" in filters[0]
    assert dict(part.dtypes)["batch_id"] == "string"
    assert part.join(keys, "idempotencyKey", "left_semi").count() == 3
    assert part.count() < 792


def test_status_snapshot_prunes_to_one_status(spark, tmp_dir):
    from cardflow.plans.context import CUTOFF
    from cardflow.sinks.writers import write_status_snapshot
    from cardflow.sources.readers import read_by_status
    p = Pipeline(spark, SF001)
    path = os.path.join(tmp_dir, "by_status")
    write_status_snapshot(p.current(CUTOFF), path)
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        held = read_by_status(spark, path, "HELD_FOR_REVIEW")
        plan = held._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert "PartitionFilters: [isnotnull(status" in plan and "HELD_FOR_REVIEW" in plan
    rows = held.collect()
    assert len(rows) == p.current(CUTOFF).where("status = 'HELD_FOR_REVIEW'").count() > 0
    assert [r.createdAt for r in rows] == sorted(r.createdAt for r in rows)


def test_missing_shared_folder_is_an_error(spark, monkeypatch):
    import pytest
    import cardflow.plans.context as C

    def no_folder(df, name):
        raise RuntimeError("spark.checkpoint.dir is not set")
    monkeypatch.setattr(C, "materialize", no_folder)
    with pytest.raises(RuntimeError, match="checkpoint"):
        C.Pipeline(spark, SF001).merchant_summary()


def test_replay_leaves_nothing_of_the_first_attempt(spark, tmp_dir):
    from cardflow.sinks.writers import append_batch, write_ledger
    p = Pipeline(spark, SF001, materialize=False)
    path = os.path.join(tmp_dir, "alerts")
    append_batch(p.alerts, path, "3")
    append_batch(p.alerts, path, "3")  # replayed batch
    append_batch(p.alerts.limit(1), path, "4")
    counts = {r.batch_id: r["count"] for r in spark.read.parquet(path).groupBy("batch_id").count().collect()}
    assert counts == {3: 157, 4: 1}
    append_batch(p.alerts.where("false"), path, "3")  # a replay with no rows
    assert spark.read.parquet(path).count() == 1
    ledger = os.path.join(tmp_dir, "ledger")
    write_ledger(p.stored, ledger, "1")
    write_ledger(p.stored.limit(2), ledger, "1")  # fewer buckets
    assert spark.read.parquet(ledger).count() == 2
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_a_folder_without_orders_serves_what_needs_none(spark, tmp_dir):
    spark.read.parquet(f"{SF001}/events.parquet").limit(20).write.parquet(f"{tmp_dir}/events.parquet")
    assert Pipeline.shared(spark, tmp_dir).valid.count() == 20


def test_changed_source_gives_a_new_pipeline(spark, tmp_dir):
    for t in ("events", "orders"):
        spark.read.parquet(f"{SF001}/{t}.parquet").limit(20).write.parquet(f"{tmp_dir}/{t}.parquet")
    a = Pipeline.shared(spark, tmp_dir)
    assert Pipeline.shared(spark, f"{tmp_dir}/") is a
    spark.read.parquet(f"{SF001}/events.parquet").limit(5).write.mode("append").parquet(f"{tmp_dir}/events.parquet")
    assert Pipeline.shared(spark, tmp_dir) is not a
