"""One key holding a third of all rows: results stay exact and the key's
rows are spread over several tasks."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from cardflow.operators import feed as FD
from cardflow.operators.authorize import authorize, normalize_requests
from cardflow.operators.skew import hot_keys, salted_join

N = 30000


def skewed_requests(spark):
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return spark.range(N).select(
        F.col("id").alias("request_id"),
        (t0 + F.make_dt_interval(secs=F.col("id").cast("int"))).alias("arrival"),
        F.lit("m").alias("merchantId"), F.lit("4111111111111234").alias("pan"),
        F.lit("4.50").alias("amount"), F.lit("USD").alias("currency"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT"))
         .otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("idempotencyKey"))


def test_salted_join_spreads_hot_key(spark):
    big = spark.range(N).select(F.when(F.col("id") % 3 == 0, F.lit("HOT"))
                                .otherwise(F.col("id").cast("string")).alias("k"), F.col("id"))
    small = big.select("k").distinct().withColumn("v", F.length("k"))
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "k", hot_rows=1000, rows_per_split=1000)
    assert [(r.k, r._splits) for r in hot.collect()] == [("HOT", 10)]
    j = salted_join(big, small, "k", hot, F.xxhash64("id"))
    assert j.count() == N
    assert j.exceptAll(big.join(small, "k")).count() == 0
    parts = (j.where(F.col("k") == "HOT").select(F.spark_partition_id().alias("p"))
             .groupBy("p").count().collect())
    assert len(parts) >= 5 and max(r["count"] for r in parts) < N / 3 / 2


def test_authorize_with_hot_key(spark):
    valid, _ = normalize_requests(skewed_requests(spark))
    out = authorize(valid)
    by = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    assert by == {"APPROVED": N - N // 3 + 1, "DUPLICATE": N // 3 - 1}
    hot = out.where(F.col("idempotencyKey") == "HOT")
    assert hot.where("outcome = 'APPROVED'").first().request_id == 0
    assert hot.select("transactionId").distinct().count() == 1


def test_a_hot_key_is_split_by_the_engine(spark):
    """The attempts of a key with a third of all rows spread over several
    tasks when they meet their resolution (sizes as for a large table)."""
    valid, _ = normalize_requests(skewed_requests(spark))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = authorize(valid.repartition(16))
        at = out.select("idempotencyKey", "request_id", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    parts = Counter(r.p for r in at if r.idempotencyKey == "HOT")
    assert sum(parts.values()) == N // 3 and len(parts) >= 3 and max(parts.values()) < N / 3 / 2


def test_feed_with_hot_transaction(spark):
    valid, _ = normalize_requests(skewed_requests(spark))
    o = authorize(valid)
    e = FD.entries(o)
    tid = o.where("idempotencyKey = 'HOT'").first().transactionId
    at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=15000.5)
    acts = spark.createDataFrame([(tid, at, 0.92, True)],
                                 "transactionId string, scored_at timestamp_ntz, riskScore double, alerted boolean")
    f = FD.apply_actions(e, FD.score_actions(acts), hot_rows=1000)
    hit = f.where(F.col("riskScore").isNotNull()).collect()
    assert [(r.request_id, r.stage) for r in hit] == [(15000, "ALERTED")]
