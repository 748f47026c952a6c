"""Costs that must not grow faster than the input."""

import os

from cardflow.schemas import REQUEST
from tests.helpers import at, req, requests_df


def test_trailing_stream_keeps_and_pairs_spans_not_records(spark, tmp_dir):
    """State of the join: a row per span of a card, not one per record (F1)."""
    from cardflow.plans.streams import stream_session
    from cardflow.sinks.writers import append_batch
    from cardflow.sources.readers import read_topic
    from cardflow.streaming.velocity import start_trailing_counts
    from pyspark.sql import functions as F
    own = stream_session(spark)
    topic, sink = os.path.join(tmp_dir, "topic"), os.path.join(tmp_dir, "out")
    times = [float(i % 90) for i in range(400)]  # equal times too, over four spans of 30 s

    def publish(rows, n):
        df = own.createDataFrame([("c", "", at(t), 0, i) for i, t in rows],
                                 "key string, value string, timestamp timestamp, source_partition int, arrival long")
        append_batch(df, topic, str(n), "json")
        q = start_trailing_counts(read_topic(own, topic), sink, sink + "_ck", "30 seconds", "5 seconds", threshold=1)
        q.awaitTermination()
        return [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"] if s["operatorName"] == "symmetricHashJoin"]

    states = publish(list(enumerate(times)), 0)
    states += publish([(1000, 80.0)], 1)            # behind the watermark: dropped
    states += publish([(1001, 10_000_000.0)], 2)    # closes what is open
    got = {r.id: r.trailing_count for r in spark.read.option("recursiveFileLookup", "true").parquet(sink).collect()}
    # the one at 80 s is late (newest 89 s, grace 5 s)
    assert got == {i: sum(1 for u in times if t - 30 <= u <= t) for i, t in enumerate(times)}
    assert max(states) <= 8
    assert spark.read.option("recursiveFileLookup", "true").parquet(sink).where(F.col("key") != "c").count() == 0


def test_request_checks_are_computed_once_a_row(spark):
    """The filter on the checks holds no copies of their expressions (F2)."""
    from cardflow.operators.authorize import normalize_requests
    from pyspark.sql import functions as F
    raw = requests_df(spark, [req(1, 0), req(2, 1, pan="4111 1111 1111 1234"), req(3, 2, pan="1"), req(4, 3, amount=" 5")])
    raw = raw.withColumn("pan", F.concat("pan", F.lit(""))).withColumn("amount", F.concat("amount", F.lit("")))
    valid, rejected = normalize_requests(raw)
    plan = valid._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
    assert sorted((r.request_id, r.pan) for r in valid.collect()) == [(1, "4111111111111234"), (2, "4111111111111234")]
    assert sorted((r.request_id, r.error) for r in rejected.collect()) == [
        (3, "Missing/invalid fields: pan (12+ digits)"), (4, "Invalid amount:  5")]


def test_hot_keys_are_found_by_hash(spark):
    """What is shuffled to find large keys is a long per key."""
    from cardflow.operators import asof
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(7)] + [("c", 1)], "k string, i int")
    seen, real = [], asof.materialize

    def spy(df, name):
        seen.append((name, [t for _, t in df.dtypes]))
        return real(df, name)

    asof.materialize = spy
    try:
        runs = asof.running(rows, "k", ["i"], "n", value=lambda w: F.count(F.lit(1)).over(w), per_slice=F.count(F.lit(1)),
                            carry=lambda w: F.sum("_part").over(w),
                            merge=lambda before, own: own + F.coalesce(before, F.lit(0)), hot_rows=3)
    finally:
        asof.materialize = real
    assert seen[0] == ("hot-hashes", ["bigint"])
    got = sorted((r.k or "", r.i, r.n) for r in asof.union_all(runs).collect())
    assert got == sorted([(k, i, i + 1) for k in ("a", "b", "") for i in range(7)] + [("c", 1, 1)])


def test_written_tables_are_compressed_and_events_appended(spark, tmp_dir):
    """Ids written once are half their text, and the event log is not
    written again for each settlement (F3)."""
    from cardflow.plans.context import Pipeline
    p = Pipeline(spark, "/root/testdata/sf0.001")
    assert all(f.endswith(".zstd.parquet") for f in p.status_events.inputFiles())
    assert set(p.status_events.inputFiles()) < set(p.all_events.inputFiles())


def test_a_batch_reads_its_requests_once(spark, tmp_dir):
    """Accepted and rejected requests come from one pass over the source."""
    from cardflow.plans.jobs import run_batch
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = [req(1, 0, key="a"), req(2, 1, key="a"), req(3, 2, key="b"), req(4, 3, pan="1")]
    got = run_batch(spark, requests_df(spark, rows).mapInPandas(count, REQUEST), os.path.join(tmp_dir, "t"), "b1")
    assert (got["requests"], got["stored"], got["rejected"]) == (4, 2, 1)
    assert read.value == 4
