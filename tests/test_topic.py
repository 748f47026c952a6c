"""Offsets of the folder topic and the trailing check as a stream-stream join."""
import os
import random

import pytest
from pyspark.sql import functions as F

from cardflow.operators.velocity import drop_late, velocity_trailing
from cardflow.plans.streams import by_time
from cardflow.session import child_folders
from cardflow.sinks import messages as M
from cardflow.sinks.writers import append_batch
from cardflow.sources.readers import read_topic
from cardflow.streaming.velocity import start_trailing_counts, trailing_batch
from tests.helpers import at

RECORD = "key string, value string, timestamp timestamp_ntz, source_partition int"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORD).withColumn("timestamp", M.ntz_as_utc("timestamp"))


def publish(spark, topic, n, rows, parts=3):
    df = records(spark, rows).repartition(parts)
    append_batch(M.with_offsets(df, M.offsets_path(topic), str(n)), topic, str(n), "json")


def read(spark, topic):
    return read_topic(spark, topic, streaming=False).withColumn("ts", F.col("event_ts").cast("timestamp_ntz"))


def test_offsets_are_gapless_over_batches_and_replays(spark, tmp_dir):
    topic = os.path.join(tmp_dir, "topic")
    rng = random.Random(1)
    batches = [[(f"c{i % 7}", f"{n}-{i}", at(n * 100 + rng.random()), rng.choice([0, 0, 0, 2, 5])) for i in range(60)]
               for n in range(3)]
    batches.insert(2, [])
    for n, rows in enumerate(batches):
        publish(spark, topic, n, rows)
        if n == 2:
            publish(spark, topic, 1, batches[1], parts=1)  # a replay, after a later batch
    got = read(spark, topic).collect()
    by_part = {}
    for r in got:
        by_part.setdefault(r.source_partition, []).append(r)
    for part, rs in by_part.items():
        rs.sort(key=lambda r: r.arrival)
        assert [r.arrival for r in rs] == list(range(len(rs)))
        want = [v for b in batches for _, _, v in sorted((t, k, v) for k, v, t, p in b if p == part)]
        assert [r.value for r in rs] == want
    assert len(got) == 180
    times = {v: t for b in batches for _, v, t, _ in b}
    assert all(r.ts == times[r.value] for r in got)  # to the microsecond


def test_offsets_of_a_partition_come_from_many_tasks(spark, tmp_dir):
    rows = [("c", f"{i:05d}", at(i / 7), 0) for i in range(3000)]
    df = M.with_offsets(records(spark, rows).repartition(5), os.path.join(tmp_dir, "o"), "0")
    assert [r.arrival for r in df.orderBy("value").collect()] == list(range(3000))


def test_old_offsets_are_forgotten(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(M, "KEPT_BATCHES", 2)
    topic = os.path.join(tmp_dir, "topic")
    for n in range(5):
        publish(spark, topic, n, [("c", str(n), at(n), 0)], parts=1)
    assert len(child_folders(spark, M.offsets_path(topic))) <= 3
    assert sorted((r.value, r.arrival) for r in read(spark, topic).collect()) == [(str(n), n) for n in range(5)]


def test_publish_topic_gives_offsets(spark, tmp_dir):
    from cardflow.plans.context import Pipeline
    from tests.conftest import SF001
    stored = Pipeline(spark, SF001, materialize=False).stored
    topic = os.path.join(tmp_dir, "topic")
    M.publish_topic(stored, topic, "a")
    t = read(spark, topic)
    assert t.count() == stored.count() == t.select("source_partition", "arrival").distinct().count()
    late = drop_late(t.drop("timestamp"), size="1 hour", arrival="arrival", tiebreak="arrival")
    assert late.where("late").count() == 0  # replayed by offset, which follows the event time


def rows_with_odd_ids(seed):
    """Three cards over three partitions whose offsets repeat, several
    records of a card at one microsecond, up to 4 s out of order."""
    rnd = random.Random(seed)
    t, rows, next_offset = 0.0, [], [0, 0, 0]
    for _ in range(150):
        t += rnd.choice([0, 0.5, 2, 9])
        card = rnd.choice(["c0", "c0", "c1", None])
        part = {"c0": 0, "c1": 1, None: 2}[card]
        rows.append((part, next_offset[part], card, round(t - rnd.choice([0, 0, 1, 4]), 1)))
        next_offset[part] += 1
    return rows


def brute(rows, size=30):
    out = {}
    for p, i, c, t in rows:
        n = sum(c2 == c and t - size <= t2 <= t for _, _, c2, t2 in rows)
        if n >= 3:
            out[p, i, c, at(t)] = n
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_join_stream_equals_batch_over_restarts(spark, tmp_dir, seed):
    rows = rows_with_odd_ids(seed)
    topic, sink, ck = (os.path.join(tmp_dir, x) for x in ("topic", "sink", "ck"))
    for n in range(5):
        part = rows[n * 30:n * 30 + 30]
        df = spark.createDataFrame([(c, "v", at(t), p, i) for p, i, c, t in part], RECORD + ", arrival long")
        append_batch(df.withColumn("timestamp", M.ntz_as_utc("timestamp")).repartition(2), topic, str(n), "json")
        start_trailing_counts(read_topic(spark, topic), sink, ck, grace="10 seconds").awaitTermination()
    tick = spark.createDataFrame([("clock", "", at(10_000), 9, 0)], RECORD + ", arrival long")
    append_batch(tick, topic, "clock", "json")
    start_trailing_counts(read_topic(spark, topic), sink, ck, grace="10 seconds").awaitTermination()
    got = [((r.source_partition, r.id, r.key, r.ts), r.trailing_count) for r in spark.read.parquet(sink).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(rows)


def test_early_counts_keep_partitions_apart(spark, tmp_dir):
    state, sink = os.path.join(tmp_dir, "state"), os.path.join(tmp_dir, "sink")
    rows = rows_with_odd_ids(5)
    for n in range(5):
        df = spark.createDataFrame([(p, i, c, at(t)) for p, i, c, t in rows[n * 30:n * 30 + 30]],
                                   "source_partition int, arrival long, key string, event_ts timestamp_ntz")
        trailing_batch(df, state, sink, n, grace="10 seconds", id_col="arrival")
    got = {}
    for r in spark.read.parquet(sink).collect():
        k = r.source_partition, r.id, r.key, r.ts
        got[k] = max(got.get(k, 0), r.trailing_count)
    assert got == brute(rows)
    # one record per card and partition, all with offset 1: no alert
    for n in range(3):
        df = spark.createDataFrame([(p, 1, f"d{p}", at(n)) for p in range(3)],
                                   "source_partition int, arrival long, key string, event_ts timestamp_ntz")
        trailing_batch(df.where(F.lit(n == 0)), state + "2", sink + "2", n, id_col="arrival")
    assert spark.read.parquet(sink + "2").count() == 0


def test_batch_counts_records_that_share_everything(spark):
    rows = [(1, "c", at(0)), (1, "c", at(0)), (2, "c", at(10)), (1, "c", at(0)), (3, "d", at(0))]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz")
    got = sorted((r.id, r.trailing_count) for r in velocity_trailing(df, threshold=1).collect())
    assert got == [(1, 3), (1, 3), (1, 3), (2, 4), (3, 1)]


def test_by_time_keeps_every_row(spark):
    df = spark.createDataFrame([(at(i * i),) for i in range(30)], "ts timestamp_ntz")
    parts = [[r.ts for r in b.collect()] for b in by_time(df, "ts", 4)]
    assert sorted(x for p in parts for x in p) == [at(i * i) for i in range(30)]
    assert all(max(a) < min(b) for a, b in zip(parts, parts[1:]) if a and b)


def landed(spark, topic, n, rows, key="c"):
    df = spark.createDataFrame([(key, "v", at(t), p, i) for p, i, t in rows], RECORD + ", arrival long")
    append_batch(df.withColumn("timestamp", M.ntz_as_utc("timestamp")).repartition(2), topic, str(n), "json")


def test_lateness_as_a_stream_equals_the_batch_rule(spark, tmp_dir):
    """The micro-batches of the blueprint and a second partition, the query
    restarted after each."""
    from cardflow.operators.velocity import velocity_exact
    from cardflow.streaming.velocity import start_lateness
    topic, sink, ck = (os.path.join(tmp_dir, x) for x in ("topic", "sink", "ck"))
    files, offset, rng = [[1, 2, 3, 4], [34.9, 29], [28, 35], [27, 36], [26, 37]], 0, random.Random(4)
    every = []
    for n, secs in enumerate(files):
        rows = []
        for s in secs:
            rows += [(0, offset, s), (1, offset, round(rng.uniform(0, 40), 1))]
            offset += 1
        every += rows
        landed(spark, topic, n, rows)
        start_lateness(read_topic(spark, topic), sink, ck).awaitTermination()  # a restart each
    got = {(r.source_partition, r.id): (r.late, r.seen_max) for r in spark.read.parquet(sink).collect()}
    df = spark.createDataFrame([("c", at(t), p, i) for p, i, t in every], "key string, ts timestamp_ntz, source_partition int, arrival long")
    want = drop_late(df, tiebreak="arrival")
    assert got == {(r.source_partition, r.arrival): (r.late, r.seen_max) for r in want.collect()}
    assert {k for k, v in got.items() if v[0]} and not all(v[0] for v in got.values())
    marks = spark.read.parquet(sink).where("not late")
    counts = {(r.w, r.n) for r in marks.groupBy(F.window("ts", "30 seconds")["start"].alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    exact = velocity_exact(df, threshold=1, tiebreak="arrival")
    assert counts == {(r.window_start, r["count"]) for r in exact.collect()}


def test_state_is_the_same_after_a_restart(spark, tmp_dir):
    from cardflow.streaming.velocity import start_velocity_alerts, velocity_state
    topic, sink, ck = (os.path.join(tmp_dir, x) for x in ("topic", "sink", "ck"))

    def run(n, rows):
        if rows:
            landed(spark, topic, n, rows)
        start_velocity_alerts(read_topic(spark, topic), sink, ck, threshold=1).awaitTermination()
        return {(r.window_start, r.key): r["count"] for r in velocity_state(spark, ck).collect()}
    assert run(0, [(0, 0, 1), (0, 1, 2), (0, 2, 31)]) == {(at(0), "c"): 2, (at(30), "c"): 1}
    before = run(1, [])  # a restart without new records
    assert before == {(at(0), "c"): 2, (at(30), "c"): 1}
    after = run(2, [(0, 3, 33), (0, 4, 3)])
    assert after == {(at(0), "c"): 3, (at(30), "c"): 2}
    assert run(3, [(0, 5, 70)]).keys() == {(at(60), "c")}  # windows closed by the watermark have left the state
