import json
import os

from pyspark.sql import functions as F

from cardflow.sources.readers import read_fraud_queue, read_requests, read_topic
from cardflow.streaming.authorize import authorize_batch, start_authorizer
from cardflow.streaming.scoring import start_scoring
from cardflow.streaming.velocity import start_velocity_alerts
from tests.conftest import SF001
from tests.helpers import at

CARD = "**** **** **** 1234"


_MTIME = [1_700_000_000]


def write_lines(folder, name, rows):
    """One JSON-lines file; each new file is strictly newer, because the
    file source admits files in modification-time order."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    _MTIME[0] += 10
    os.utime(path, (_MTIME[0], _MTIME[0]))


def iso(seconds):
    return at(seconds).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def test_velocity_stream_lateness(spark, tmp_dir):
    land = os.path.join(tmp_dir, "topic")
    files = [[1, 2, 3, 4], [34.9, 29], [28, 35], [27, 36], [26, 37]]
    for i, secs in enumerate(files):
        write_lines(land, f"part-{i:03d}.json",
                    [{"key": CARD, "value": "{}", "timestamp": iso(s), "source_partition": 0,
                      "arrival": i} for s in secs])
    src = read_topic(spark, land, max_per_trigger=1)
    q = start_velocity_alerts(src, os.path.join(tmp_dir, "alerts"), os.path.join(tmp_dir, "ck"),
                              threshold=1)
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp_dir, "alerts"))
    first = out.where(F.col("window_start") == F.lit(at(0)).cast("timestamp"))
    counts = sorted(r["count"] for r in first.collect())
    # updates 4, 5, 6, 7: the previous batch's watermark admits 27, drops 26
    assert counts == [4, 5, 6, 7]
    line = first.orderBy("count").first().message
    assert line == ("   >>> VELOCITY ALERT: card=**** **** **** 1234 count=4 "
                    "window=[2024-01-01T00:00:00Z - 2024-01-01T00:00:30Z]")


def test_velocity_stream_equals_batch_twin(spark, tmp_dir):
    from cardflow.plans.context import Pipeline
    from cardflow.sinks.messages import topic_records
    from cardflow.operators.velocity import velocity_tumbling
    from cardflow.functions.pan import mask_pan
    p = Pipeline(spark, SF001, materialize=False)
    recs = p.requests.select(mask_pan("pan").alias("key"), F.lit("{}").alias("value"),
                             F.col("arrival").cast("timestamp").alias("timestamp"),
                             F.lit(0).alias("source_partition"), F.col("request_id").alias("arrival"))
    land = os.path.join(tmp_dir, "topic")
    recs.repartition(4).write.json(land)
    q = start_velocity_alerts(read_topic(spark, land), os.path.join(tmp_dir, "alerts"),
                              os.path.join(tmp_dir, "ck"), size="1 day")
    q.awaitTermination(180)
    got = spark.read.parquet(os.path.join(tmp_dir, "alerts")).groupBy("window_start", "key") \
        .agg(F.max("count").alias("count"))
    batch = velocity_tumbling(p.requests.select(mask_pan("pan").alias("key"), F.col("arrival").alias("ts")),
                              size="1 day")
    assert got.count() == batch.count() == 173
    diff = got.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "key", "count") \
        .exceptAll(batch.select("window_start", "key", "count"))
    assert diff.count() == 0
    assert topic_records(p.stored).count() == p.stored.count()


def test_scoring_stream_with_dead_letter(spark, tmp_dir):
    from cardflow.plans.context import Pipeline
    from cardflow.sinks.messages import publish_queue
    p = Pipeline(spark, SF001, materialize=False)
    land = os.path.join(tmp_dir, "queue")
    publish_queue(p.stored, land, "0")
    write_lines(land, "poison.json", [{"body": "{bad", "amount": "1"}])
    out = os.path.join(tmp_dir, "out")
    q = start_scoring(read_fraud_queue(spark, land, max_per_trigger=1), out, os.path.join(tmp_dir, "ck"))
    q.awaitTermination(180)
    dead = spark.read.parquet(os.path.join(out, "dead_letter"))
    assert [r.body for r in dead.collect()] == ["{bad"]
    assert spark.read.parquet(os.path.join(out, "scores")).count() == 792
    assert spark.read.parquet(os.path.join(out, "alerts")).count() == 157
    assert spark.read.parquet(os.path.join(out, "holds")).count() == 157


def test_authorizer_stream_and_replay(spark, tmp_dir):
    land = os.path.join(tmp_dir, "req")

    def r(rid, s, key, amount="4.50"):
        return {"request_id": rid, "arrival": at(s).isoformat(), "merchantId": "m1",
                "pan": "4111 1111 1111 1234", "amount": amount, "currency": "USD", "idempotencyKey": key}
    write_lines(land, "a.json", [r(1, 1, "k1"), r(2, 2, "k2"), r(3, 3, "k1")])
    write_lines(land, "b.json", [r(4, 10, "k1", "9.99"), r(5, 11, "k3"), r(6, 12, "", "1.00")])
    ledger = os.path.join(tmp_dir, "ledger")
    out = os.path.join(tmp_dir, "out")
    q = start_authorizer(read_requests(spark, land, streaming=True, max_files_per_trigger=1),
                         ledger, out, os.path.join(tmp_dir, "ck"))
    q.awaitTermination(180)
    oc = {x.request_id: x.outcome for x in spark.read.parquet(os.path.join(out, "outcomes")).collect()}
    assert oc == {1: "APPROVED", 2: "APPROVED", 3: "DUPLICATE", 4: "DUPLICATE", 5: "APPROVED", 6: "APPROVED"}
    led = spark.read.parquet(ledger)
    assert led.count() == 4 and led.select("idempotencyKey").distinct().count() == 4
    # replaying epoch 0 rewrites its own partition with the same outcomes
    batch0 = read_requests(spark, os.path.join(land, "a.json"))
    authorize_batch(batch0, ledger, out, "0")
    led2 = spark.read.parquet(ledger)
    assert led2.count() == 4
    oc0 = {x.request_id: x.outcome for x in
           spark.read.parquet(os.path.join(out, "outcomes")).where("batch_id = '0'").collect()}
    assert oc0 == {1: "APPROVED", 2: "APPROVED", 3: "DUPLICATE"}


def test_trailing_stream_across_batches(spark, tmp_dir):
    from cardflow.streaming.velocity import start_velocity_trailing
    land = os.path.join(tmp_dir, "topic")
    # burst split over micro-batches and over a tumbling edge: 28, 29 | 31 | 32 | 100
    for i, secs in enumerate([[28, 29], [31], [32], [100]]):
        write_lines(land, f"part-{i:03d}.json",
                    [{"key": CARD, "value": "{}", "timestamp": iso(s), "source_partition": 0,
                      "arrival": int(s * 10)} for s in secs])
    q = start_velocity_trailing(read_topic(spark, land, max_per_trigger=1), os.path.join(tmp_dir, "alerts"),
                                os.path.join(tmp_dir, "state"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmp_dir, "alerts"))
    got = sorted((r.id, r.trailing_count) for r in out.collect())
    assert got == [(310, 3), (320, 4)]


def test_stream_first_per_key(spark, tmp_dir):
    from cardflow.streaming.authorize import first_per_key
    land = os.path.join(tmp_dir, "req")

    def r(rid, s, key):
        return {"request_id": rid, "arrival": at(s).isoformat(), "merchantId": "m1",
                "pan": "4111111111111234", "amount": "1.00", "currency": "USD", "idempotencyKey": key}
    write_lines(land, "a.json", [r(1, 1, "k1"), r(2, 2, "k2")])
    write_lines(land, "b.json", [r(3, 3, "k1"), r(4, 4, "k3")])
    stream = first_per_key(read_requests(spark, land, streaming=True, max_files_per_trigger=1))
    q = (stream.writeStream.format("parquet").option("path", os.path.join(tmp_dir, "out"))
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(x.request_id for x in spark.read.parquet(os.path.join(tmp_dir, "out")).collect())
    assert got == [1, 2, 4]


def test_kafka_source_without_connector_says_so(spark):
    import pytest
    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        read_fraud_queue(spark, "localhost:9092", fmt="kafka")
    with pytest.raises(RuntimeError, match="spark-sql-kafka"):
        read_topic(spark, "localhost:9092", fmt="kafka")


def test_stream_first_per_key_within_watermark(spark, tmp_dir):
    from cardflow.streaming.authorize import first_per_key
    land = os.path.join(tmp_dir, "req")

    def r(rid, s, key):
        return {"request_id": rid, "arrival": at(s).isoformat(), "merchantId": "m1",
                "pan": "4111111111111234", "amount": "1.00", "currency": "USD", "idempotencyKey": key}
    write_lines(land, "a.json", [r(1, 1, "k1"), r(2, 2, "k2")])
    write_lines(land, "b.json", [r(3, 5, "k1"), r(4, 6, "k3")])
    stream = first_per_key(read_requests(spark, land, streaming=True, max_files_per_trigger=1),
                           event_ts="arrival", delay="1 hour")
    q = (stream.writeStream.format("parquet").option("path", os.path.join(tmp_dir, "out"))
         .option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(x.request_id for x in spark.read.parquet(os.path.join(tmp_dir, "out")).collect())
    assert got == [1, 2, 4]  # the retry of k1 within the delay is dropped


def test_trailing_stream_equals_batch_twin_on_shuffled_epochs(spark, tmp_dir):
    import random
    from cardflow.operators.velocity import velocity_trailing
    from cardflow.streaming.velocity import trailing_batch
    rnd = random.Random(8)
    t, rows = 0.0, []
    for i in range(120):
        t += rnd.choice([0.5, 2, 6])
        rows.append((i, f"c{rnd.randrange(2)}", round(t - rnd.choice([0, 0, 1, 4]), 1)))  # at most 4 s late
    epochs, schema = [rows[i:i + 15] for i in range(0, 120, 15)], "id long, key string, event_ts timestamp_ntz"
    for e in epochs:
        rnd.shuffle(e)
    state, sink = os.path.join(tmp_dir, "state"), os.path.join(tmp_dir, "alerts")
    for n, e in enumerate(epochs):
        df = spark.createDataFrame([(i, k, at(s)) for i, k, s in e], schema)
        trailing_batch(df, state, sink, n, grace="10 seconds")
        if n == 3:  # a replayed epoch changes nothing
            trailing_batch(df, state, sink, n, grace="10 seconds")
    got = {r.id: r.n for r in spark.read.parquet(sink).groupBy("id").agg(F.max("trailing_count").alias("n")).collect()}
    every = spark.createDataFrame([(i, k, at(s)) for i, k, s in rows], "id long, key string, ts timestamp_ntz")
    assert got == {r.id: r.trailing_count for r in velocity_trailing(every).collect()}
    assert len(os.listdir(state)) == 2 and spark.read.parquet(sink + "_late").count() == 0


def test_out_of_order_record_lifts_an_earlier_one(spark, tmp_dir):
    from cardflow.streaming.velocity import trailing_batch
    state, sink, schema = os.path.join(tmp_dir, "state"), os.path.join(tmp_dir, "alerts"), "id long, key string, event_ts timestamp_ntz"
    trailing_batch(spark.createDataFrame([(1, CARD, at(10)), (2, CARD, at(13))], schema), state, sink, 0)
    trailing_batch(spark.createDataFrame([(3, CARD, at(11)), (4, CARD, at(1))], schema), state, sink, 1)
    assert [(r.id, r.trailing_count) for r in spark.read.parquet(sink).collect()] == [(2, 3)]
    assert [r.id for r in spark.read.parquet(sink + "_late").collect()] == [4]  # beyond the grace of 5 s


def test_landing_folder_to_scores_and_alerts(spark, tmp_dir):
    """Requests through the authorizer, scorer and velocity streams, each
    reading what the one before it wrote."""
    from cardflow.sources.readers import read_receipts
    land, out = os.path.join(tmp_dir, "land"), os.path.join(tmp_dir, "out")
    sent = [(i, i * 2, f"k{i}", "2500.01" if i % 4 == 0 else "9.50") for i in range(12)] + [(20, 30, "k1", "9.50"), (21, 31, "k99", "2500.004")]
    write_lines(land, "a.json", [{"request_id": i, "arrival": at(s).isoformat(), "merchantId": "m/1", "pan": "4111 1111 1111 ABCD",
                                  "amount": a, "currency": "USD", "idempotencyKey": k} for i, s, k, a in sent])
    start_authorizer(read_requests(spark, land, streaming=True), os.path.join(out, "ledger"), out,
                     os.path.join(tmp_dir, "ck1")).awaitTermination(120)
    start_scoring(read_fraud_queue(spark, f"{out}/fraud_queue"), f"{out}/scoring", os.path.join(tmp_dir, "ck2")).awaitTermination(120)
    start_velocity_alerts(read_topic(spark, f"{out}/topic"), f"{out}/velocity", os.path.join(tmp_dir, "ck3")).awaitTermination(120)
    assert [r.error for r in spark.read.parquet(f"{out}/rejected").collect()] == ["Invalid amount: 2500.004"]
    assert spark.read.parquet(f"{out}/scoring/scores").count() == 12
    assert spark.read.parquet(f"{out}/scoring/alerts").count() == 3
    assert sorted(r["count"] for r in spark.read.parquet(f"{out}/velocity").collect()) == [12]
    row = spark.read.parquet(f"{out}/ledger").first()
    assert read_receipts(spark, f"{out}/receipts", f"receipts/m/1/{row.transactionId}.json").count() == 1


def _messages(spark, rows):
    return spark.createDataFrame(rows, "body string, amount string, sent_at timestamp")


def test_redelivery_until_scored_or_dead(spark, tmp_dir):
    """A message without a score twice is scored once and leaves no dead
    letter; one that is never readable leaves after five receives; a
    replayed epoch counts nothing twice."""
    from cardflow.plans.context import Pipeline
    from cardflow.sinks.messages import fraud_messages
    from cardflow.streaming.scoring import score_epoch
    bodies = [r.body for r in fraud_messages(Pipeline(spark, SF001, materialize=False).stored).limit(4).collect()]
    slow = json.loads(bodies[1])["transactionId"]

    def flaky(df):
        return F.when((F.col("transactionId") == slow) & (F.col("receives") < 3), None).otherwise(0.15)
    out, dead = os.path.join(tmp_dir, "out"), []
    sent = [[(bodies[0], "1", None), (bodies[1], "1", None), ("{bad", "2", None)], [(bodies[2], "1", None)], [], [(bodies[3], "1", None)], [], []]
    for n, rows in enumerate(sent):
        for _ in range(2 if n == 2 else 1):
            score_epoch(_messages(spark, rows), out, n, 5, flaky)
        dead.append(spark.read.parquet(os.path.join(out, "dead_letter")).count())
    scores = spark.read.parquet(os.path.join(out, "scores"))
    by_batch = {r.transactionId: r.batch_id for r in scores.collect()}
    assert scores.count() == 4 and by_batch[slow] == 2  # received in epochs 0, 1 and 2
    assert dead == [0, 0, 0, 0, 1, 1]
    letter = spark.read.parquet(os.path.join(out, "dead_letter")).first()
    assert (letter.body, letter.reason, letter.receives) == ("{bad", "unparsable message body", 5)
    assert len(os.listdir(os.path.join(out, "retry"))) == 2


def test_redelivery_in_the_stream(spark, tmp_dir):
    land, out = os.path.join(tmp_dir, "queue"), os.path.join(tmp_dir, "out")
    for n in range(3):
        write_lines(land, f"m{n}.json", [{"body": f"{{bad{n}", "amount": "1"}])
    q = start_scoring(read_fraud_queue(spark, land, max_per_trigger=1), out, os.path.join(tmp_dir, "ck"), max_receives=2)
    q.awaitTermination(180)
    assert sorted(r.body for r in spark.read.parquet(os.path.join(out, "dead_letter")).collect()) == ["{bad0", "{bad1"]
