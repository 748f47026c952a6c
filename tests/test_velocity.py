from pyspark.sql import functions as F
import datetime as dt


from cardflow.operators import velocity as V
from tests.helpers import at

CARD = "**** **** **** 1234"


def recs(spark, seconds, key=CARD):
    return spark.createDataFrame([(i, key, at(s)) for i, s in enumerate(seconds)],
                                 "id long, key string, ts timestamp_ntz")


def test_burst_of_four(spark):
    r = recs(spark, [1, 2, 3, 4])
    t = V.velocity_tumbling(r).collect()
    assert [(x["count"], x.window_start) for x in t] == [(4, at(0))]
    tr = sorted(x.trailing_count for x in V.velocity_trailing(r).collect())
    assert tr == [3, 4]


def test_burst_over_an_edge(spark):
    r = recs(spark, [28, 29, 31, 32])
    assert V.velocity_tumbling(r).count() == 0
    counts = sorted(x["count"] for x in V.window_counts(r).collect())
    assert counts == [2, 2]
    tr = sorted(x.trailing_count for x in V.velocity_trailing(r).collect())
    assert tr == [3, 4]


def test_trailing_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    secs = sorted(rnd.uniform(0, 300) for _ in range(200))
    keys = [rnd.choice(["a", "b", "c"]) for _ in secs]
    df = spark.createDataFrame([(i, k, at(s)) for i, (k, s) in enumerate(zip(keys, secs))],
                               "id long, key string, ts timestamp_ntz")
    got = {r.id: r.trailing_count for r in V.velocity_trailing(df, threshold=1).collect()}
    for i, (k, s) in enumerate(zip(keys, secs)):
        t = at(s)
        exp = sum(1 for k2, s2 in zip(keys, secs) if k2 == k and t - dt.timedelta(seconds=30) <= at(s2) <= t)
        assert got[i] == exp


def test_exact_lateness(spark):
    # arrival order: 1,2,3,4 | 34.9,29 | 28,35 | 27,36 | 26,37
    order = [1, 2, 3, 4, 34.9, 29, 28, 35, 27, 36, 26, 37]
    df = spark.createDataFrame([(i, CARD, at(s), i, 0) for i, s in enumerate(order)],
                               "id long, key string, ts timestamp_ntz, arrival long, source_partition int")
    m = V.drop_late(df, size="30 seconds", grace="5 seconds", chunk="3")
    late = {r.id for r in m.where("late").collect()}
    assert late == {8, 10}  # 27 and 26
    ex = V.velocity_exact(df, size="30 seconds", grace="5 seconds", threshold=1, chunk="3").collect()
    got = {r.window_start: r["count"] for r in ex}
    assert got[at(0)] == 6 and got[at(30)] == 4


def test_exact_lateness_chunking_is_invisible(spark):
    import random
    rnd = random.Random(3)
    rows = [(i, CARD, at(rnd.uniform(0, 200)), i, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, arrival long, source_partition int")
    a = {r.id: r.late for r in V.drop_late(df, chunk="7").collect()}
    b = {r.id: r.late for r in V.drop_late(df, chunk="100000").collect()}
    c = {r.id: r.late for r in V.drop_late(df, rows_per_chunk=5).collect()}
    d = {r.id: r.late for r in V.drop_late(df, balanced=True, chunks=7).collect()}
    assert a == b == c == d and any(a.values())


def test_hot_card_is_split_by_time(spark):
    # one card, 3,000 records over 300 s: a 30 s window holds ~300 of them,
    # but no window group holds more than one 30/32 s slice
    r = spark.createDataFrame([(i, CARD, at(i / 10)) for i in range(3000)],
                              "id long, key string, ts timestamp_ntz")
    out = V.velocity_trailing(r, threshold=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("sb#" in line and "Window" in line for line in plan.split("\n"))
    got = {x.id: x.trailing_count for x in out.collect()}
    assert got[2999] == 301 and got[0] == 1 and got[300] == 301


def test_trailing_slices_for_long_windows(spark):
    assert V._slices(86_400_000_000, None) == 1440          # 1 day: one-minute slices
    assert V._slices(30_000_000, None) == 32                 # 30 s: 1/32 of the window
    import pytest
    with pytest.raises(ValueError, match="7 slices"):          # not a divisor
        V._slices(30_000_000, 7)
    import random
    rnd = random.Random(11)
    secs = sorted(rnd.uniform(0, 3 * 86400) for _ in range(150))
    df = spark.createDataFrame([(i, "c", at(s)) for i, s in enumerate(secs)],
                               "id long, key string, ts timestamp_ntz")
    got = {r.id: r.trailing_count for r in V.velocity_trailing(df, size="1 day", threshold=1).collect()}
    for i, s in enumerate(secs):
        assert got[i] == sum(1 for s2 in secs if s - 86400 <= s2 <= s)


def test_exact_lateness_over_ten_years(spark):
    import random
    rnd = random.Random(5)
    secs = sorted(rnd.uniform(0, 10 * 365 * 86400) for _ in range(60))
    rows = [(i, CARD, at(s - rnd.choice([0, 0, 40])), at(s), 0) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, arrival timestamp_ntz, source_partition int")
    got = {r.id: r.late for r in V.drop_late(df).collect()}
    by_chunks = {r.id: r.late for r in V.drop_late(df, rows_per_chunk=3).collect()}
    seen, want = dt.datetime.min, {}
    for i, _, ts, _, _ in rows:
        seen = max(seen, ts)
        start = at(int((ts - at(0)).total_seconds() // 30) * 30)
        want[i] = start + dt.timedelta(seconds=30) <= seen - dt.timedelta(seconds=5)
    assert got == by_chunks == want


def test_one_partition_with_a_third_of_all_records(spark):
    df = spark.range(3000).selectExpr(
        "id", "cast(id % 5 as string) as key", "timestampadd(SECOND, cast(id % 200 as int), timestamp_ntz'2024-01-01') as ts",
        "id as arrival", "cast(if(id % 3 = 0, 0, id % 7 + 1) as int) as source_partition")
    out = V.drop_late(df, rows_per_chunk=50)
    whole = V.drop_late(df, rows_per_chunk=10_000)
    assert out.exceptAll(whole).count() == 0 and out.count() == 3000


def test_no_window_holds_a_card_for_all_time(spark):
    r = spark.createDataFrame([(i, CARD, at(i * 7.3)) for i in range(400)], "id long, key string, ts timestamp_ntz")
    out = V.velocity_trailing(r, threshold=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and all("group#" in x or "sb#" in x for x in windows)
    got = {x.id: x.trailing_count for x in out.collect()}
    assert got == {i: sum(1 for j in range(i + 1) if (i - j) * 7.3 <= 30) for i in range(400)}


def test_a_burst_of_arrivals_is_cut_by_rows(spark):
    """A third of a partition's records arrive within one second; no slice
    holds more than its share, and nothing of the result changes."""
    n = 6000
    arrival = F.when(F.col("id") % 3 == 0, F.lit(5_000_000) + F.col("id")).otherwise(F.col("id") * 1_000_000)
    df = spark.range(n).select(
        "id", F.lit("c").alias("key"), arrival.alias("arrival"), F.lit(0).alias("source_partition"),
        F.expr("timestampadd(SECOND, cast(id * 7919 % 900 as int), timestamp_ntz'2024-01-01')").alias("ts"))
    one = {r.id: (r.late, r.seen_max) for r in V.drop_late(df).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = V.drop_late(df, rows_per_chunk=500)
        assert {r.id: (r.late, r.seen_max) for r in cut.collect()} == one
        sizes = [r["count"] for r in cut.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(one) == n and len(sizes) >= 4
