"""The batch job over tables: two batches, a replay, settlement."""

import datetime as dt
import os

from pyspark.sql import functions as F

from cardflow.plans.context import Pipeline
from cardflow.plans.jobs import run_batch
from cardflow.sources.readers import read_requests
from tests.conftest import SF001


def test_two_batches_replay_and_settle(spark, tmp_dir):
    p = Pipeline(spark, SF001, materialize=False)
    # land the fixture requests as JSON in two halves (by day of month)
    land = os.path.join(tmp_dir, "landing")
    req = p.requests.withColumn("half", (F.dayofmonth("arrival") > 15).cast("int"))
    req.write.partitionBy("half").json(land)
    first = read_requests(spark, os.path.join(land, "half=0"))
    second = read_requests(spark, os.path.join(land, "half=1"))
    root = os.path.join(tmp_dir, "tables")

    c1 = run_batch(spark, first, root, "b1")
    c1_again = run_batch(spark, first, root, "b1")  # replay: same outcome, no duplicates
    assert c1 == c1_again
    before = spark.read.parquet(os.path.join(root, "outcomes")).where("outcome = 'APPROVED' and amount > 2500")
    held = before.orderBy("transactionId").first()
    asked = spark.createDataFrame(
        [(held.transactionId, held.arrival + dt.timedelta(days=1)), (held.transactionId[:-1] + "x", held.arrival),
         (before.orderBy(F.desc("transactionId")).first().transactionId, dt.datetime(2000, 1, 1))],
        "transactionId string, released_at timestamp_ntz")
    c2 = run_batch(spark, second, root, "b2", settle_at=dt.datetime(2024, 2, 15), releases=asked)
    # one release finds its entry; the unknown one and the early one do not
    assert spark.read.parquet(os.path.join(root, "release_not_found")).count() == 2
    assert c1["stored"] + c2["stored"] == 792 and c1["rejected"] == c2["rejected"] == 0

    ledger = spark.read.parquet(os.path.join(root, "ledger"))
    assert ledger.count() == 792 and ledger.select("idempotencyKey").distinct().count() == 792
    outcomes = spark.read.parquet(os.path.join(root, "outcomes"))
    assert outcomes.count() == 1000
    assert outcomes.where("outcome = 'APPROVED'").count() == 792
    assert spark.read.parquet(os.path.join(root, "alerts")).count() == 157
    # settled everything not held, with the FIXTURES total
    assert c2["settled"] == 792 - 157 + 1  # the released one settles
    notice = spark.read.parquet(os.path.join(root, "notices")).first()
    assert notice.message.startswith("Settled 636 transaction(s) totaling ")
    settled = spark.read.parquet(os.path.join(root, "status_events")).where("status = 'SETTLED'")
    assert held.idempotencyKey in {r.idempotencyKey for r in settled.collect()}
    receipts = spark.read.text(os.path.join(root, "receipts"))
    assert receipts.count() == 792


def test_card_numbers_are_encrypted_on_the_write_path(spark, tmp_dir):
    import pytest
    from cardflow.functions.pan import decrypt_pan
    from cardflow.session import PAN_KEY_CONF, pan_key
    p = Pipeline(spark, SF001, materialize=False)
    some = p.requests.limit(20)
    with pytest.raises(RuntimeError, match="panKey"):
        run_batch(spark, some, os.path.join(tmp_dir, "none"), "b1", encrypt=True)
    spark.conf.set(PAN_KEY_CONF, "a-test-key-of-32-bytes-in-length")
    try:
        run_batch(spark, some, os.path.join(tmp_dir, "t"), "b1", encrypt=True)
        led = spark.read.parquet(os.path.join(tmp_dir, "t", "ledger"))
        pans = {r[0] for r in led.select(decrypt_pan("encryptedPan", pan_key(spark))).collect()}
    finally:
        spark.conf.unset(PAN_KEY_CONF)
    assert pans <= {r.pan for r in some.collect()} and None not in pans
