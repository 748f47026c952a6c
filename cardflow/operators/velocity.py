"""Card velocity over event time (A3, F2, W1, W2, W8), batch forms.

* Tumbling (W1): epoch-aligned windows, count per key, keep counts at or
  above the threshold.  ``groupBy(window, key).count()`` aggregates
  partially before the shuffle, so a hot card costs one partial row per
  task and window.
* Trailing (W2): for each record, records of the same key in
  ``[t - size, t]``.  A window partitioned by the key alone would put a
  hot card in one task; instead the count is assembled from sub-buckets
  of width ``size / splits`` (own sub-bucket, a per-sub-bucket count
  table, and a probe at ``t - size``), so every group is one key within
  one narrow slice of time.
* Exact lateness (W8): a record is late when its window already closed,
  i.e. window end <= (max event time seen so far in its source
  partition, in arrival order) - grace.  The running max of a large source
  partition is a two-level scan (per slice of its rows, then a carry over
  the small per-slice table), so one holding a third of all rows is still
  spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardflow.constants import VELOCITY_GRACE, VELOCITY_THRESHOLD, VELOCITY_WINDOW
from cardflow.operators.asof import running, union_all
from cardflow.session import materialize


def _seconds(duration: str) -> int:
    n, unit = duration.split()
    unit = unit.rstrip("s").lower()
    mult = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit]
    return int(float(n) * mult)


def _micros(ts_col) -> F.Column:
    from cardflow.functions.text import epoch_micros
    return epoch_micros(ts_col)


def _from_micros(us) -> F.Column:
    from cardflow.functions.text import from_epoch_micros
    return from_epoch_micros(us)


def window_counts(events: DataFrame, ts: str = "ts", key: str = "key",
                  size: str = VELOCITY_WINDOW) -> DataFrame:
    """Count per key per tumbling window (A3): window_start, window_end, key, count."""
    w = F.window(F.col(ts), size)
    return (events.groupBy(w.alias("w"), F.col(key).alias("key"))
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                    "key", "count"))


def velocity_alerts(counts: DataFrame, threshold: int = VELOCITY_THRESHOLD) -> DataFrame:
    """Windows whose count reaches the threshold, inclusive (F2, K8)."""
    return counts.where(F.col("count").isNotNull() & (F.col("count") >= threshold))


def alert_lines(alerts: DataFrame) -> DataFrame:
    """The alert line for each window at or above the threshold (K8)."""
    from cardflow.constants import VELOCITY_ALERT_TEMPLATE
    from cardflow.functions.text import iso_instant
    return alerts.select(
        "window_start", "key", "count",
        F.format_string(VELOCITY_ALERT_TEMPLATE, F.col("key"), F.col("count"),
                        iso_instant("window_start"), iso_instant("window_end")).alias("message"))


def velocity_tumbling(events: DataFrame, ts: str = "ts", key: str = "key",
                      size: str = VELOCITY_WINDOW, threshold: int = VELOCITY_THRESHOLD) -> DataFrame:
    """W1 in batch: tumbling counts at or above the threshold."""
    return velocity_alerts(window_counts(events, ts, key, size), threshold)


def _floor_div(us, n: int) -> F.Column:
    """Exact floor(us / n) in integer arithmetic (also for negative us)."""
    return ((us - F.pmod(us, F.lit(n))) / F.lit(n)).cast("bigint")


def _slices(width_us: int, requested: int | None) -> int:
    """Sub-buckets per window: the window must be a whole number of them.
    By default slices are at most a minute long (long windows) and at most
    1/32 of the window (short ones)."""
    if requested:
        if requested < 1 or width_us % requested:
            raise ValueError(f"a window of {width_us} us is no whole number of {requested} slices")
        return requested
    minute = 60_000_000
    if width_us > 32 * minute and width_us % minute == 0:
        return width_us // minute
    return 32 if width_us % 32 == 0 else 1


def velocity_trailing(events: DataFrame, ts: str = "ts", key: str = "key", id_col: str = "id",
                      size: str = VELOCITY_WINDOW, threshold: int = VELOCITY_THRESHOLD,
                      emit: str | None = None, splits: int | None = None) -> DataFrame:
    """Every record whose trailing count over ``[t - size, t]`` reaches
    the threshold; output id, key, ts, trailing_count.  Records may share
    id, key and time: each is a record of its own.

    Exact decomposition over sub-buckets of width ``size / splits`` (by
    default at most a minute, and at most 1/32 of the window): the
    count for a record at t is (records of its own sub-bucket up to t) +
    (all records of the sub-buckets strictly between, from a per-(key,
    sub-bucket) count table) + (records of the first sub-bucket at or
    after t - size, found by a probe placed at t - size).  One window pass
    over groups of (key, sub-bucket) yields all three parts: the count
    table enters the same groups as extra rows, and a probe's result goes
    back to its record by one aggregation on id, key and time.  Every group
    is one key within one slice of time, so a hot card is spread over its
    time span; the count table has one row per key and slice with data.

    ``emit`` names a boolean column: rows where it is false are counted
    but not returned (the retained tail of a stream).
    """
    width = _seconds(size) * 1_000_000
    m = _slices(width, splits)
    sub = width // m
    flag = F.col(emit) if emit else F.lit(True)
    base = events.select(F.col(id_col).alias("id"), F.col(key).alias("key"),
                         F.col(ts).alias("ts"), _micros(F.col(ts)).alias("us"), flag.alias("_emit"))
    ts_type, id_type = base.schema["ts"].dataType, base.schema["id"].dataType
    data = base.select("id", "key", "ts", "us", "_emit", _floor_div(F.col("us"), sub).alias("sb"),
                       F.lit(1).alias("is_data"), F.lit("data").alias("kind"),
                       F.lit(None).cast("bigint").alias("mid"))
    lo = F.col("us") - F.lit(width)
    # a probe carries its record's key and time (``ts`` is not used for
    # ordering), so the fold below groups on (id, key, ts) by hash
    probes = base.where(F.col("_emit")).select(
        "id", "key", "ts", lo.alias("us"), "_emit",
        _floor_div(lo, sub).alias("sb"), F.lit(0).alias("is_data"), F.lit("probe").alias("kind"),
        F.lit(None).cast("bigint").alias("mid"))
    # records of the sub-buckets strictly between, per (key, sub-bucket):
    # a small table (one row per key and slice with data)
    per_sb = data.groupBy("key", "sb").agg(F.count(F.lit(1)).alias("n"))
    # the m - 1 slices before one lie in its own span of m slices and in the
    # span before: each count enters its own span's group and the next one's,
    # so a group holds at most 2 m counts, however long a card is in use
    span = _floor_div(F.col("sb"), m)
    spans = per_sb.withColumn("span", span).withColumn("group", F.explode(F.array(F.col("span"), F.col("span") + 1)))
    between = Window.partitionBy("key", "group").orderBy("sb").rangeBetween(-(m - 1), -1)
    summed = spans.withColumn("before", F.sum("n").over(between)).where(F.col("group") == F.col("span"))
    mids = summed.select(
        F.lit(None).cast(id_type).alias("id"), "key", F.lit(None).cast(ts_type).alias("ts"),
        F.lit(None).cast("bigint").alias("us"), F.lit(False).alias("_emit"), "sb",
        F.lit(0).alias("is_data"), F.lit("mid").alias("kind"),
        F.coalesce(F.col("before"), F.lit(0)).alias("mid"))
    grp = Window.partitionBy("key", "sb")
    upto = grp.orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    before = grp.orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    ranked = data.unionByName(probes).unionByName(mids).select(
        "id", "key", "ts", "_emit", "kind",
        F.sum("is_data").over(upto).alias("le"),
        F.sum("is_data").over(before).alias("lt"),
        F.sum("is_data").over(grp).alias("tot"),
        F.max("mid").over(grp).alias("c_mid"))
    is_data = F.col("kind") == "data"
    part = (ranked.where((is_data & F.col("_emit")) | (F.col("kind") == "probe"))
            .select("id", "key", "ts", is_data.cast("int").alias("row"),
                    F.when(is_data, F.col("le") + F.coalesce(F.col("c_mid"), F.lit(0)))
                    .otherwise(F.col("tot") - F.coalesce(F.col("lt"), F.lit(0))).alias("c")))
    # records that share id, key and time have the same count: the sum over
    # all of them holds it once per record, and it comes out once per record
    out = (part.groupBy("id", "key", "ts").agg(F.sum("row").alias("rows"), F.sum("c").alias("c"))
           .withColumn("trailing_count", F.expr("c div rows"))
           .where(F.col("trailing_count") >= threshold))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows")))
            .select("id", "key", "ts", "trailing_count"))


def drop_late(records: DataFrame, size: str = VELOCITY_WINDOW, grace: str = VELOCITY_GRACE,
              ts: str = "ts", arrival: str = "arrival", tiebreak: str = "id",
              partition: str = "source_partition", chunk: str | None = None,
              rows_per_chunk: int = 1_000_000, balanced: bool = False,
              chunks: int | None = None) -> DataFrame:
    """Mark each record ``late`` by the exact per-record grace rule.

    ``arrival`` is the replay order (a broker offset or a timestamp) with
    ``tiebreak`` making it total.  A source partition of at most
    ``rows_per_chunk`` records is one run; larger ones are cut into slices by
    rows, whatever the pattern of their arrivals, with the newest time of the
    slices before carried in (``operators.asof``).  ``chunk`` cuts by a fixed
    width of the order instead (a count for offsets, a duration for
    timestamps), ``balanced`` into ``chunks`` equal ranges.  Adds
    window_start, window_end, seen_max, late.
    """
    width = _seconds(size) * 1_000_000
    grace_us = _seconds(grace) * 1_000_000
    arr = F.col(arrival)
    is_ts = dict(records.dtypes)[arrival].startswith("timestamp")
    arr_num = _micros(arr) if is_ts else arr.cast("bigint")
    r = records.withColumn("_us", _micros(F.col(ts))).withColumn("_arr", arr_num)
    if balanced or chunk is not None:
        j = _chunked(r, partition, tiebreak, is_ts, chunk if not balanced else None, chunks)
    else:
        order = ["_arr", F.col(tiebreak)]
        j = union_all(running(r, partition, order, "_seen", value=lambda w: F.max("_us").over(w),
                              per_slice=F.max("_us"), carry=lambda w: F.max("_part").over(w),
                              merge=lambda before, own: F.greatest(own, F.coalesce(before, own)), hot_rows=rows_per_chunk))
    start = _floor_div(F.col("_us"), width) * F.lit(width)
    out = (j.withColumn("_start", start.cast("bigint"))
           .withColumn("window_start", _from_micros(F.col("_start")))
           .withColumn("window_end", _from_micros(F.col("_start") + F.lit(width)))
           .withColumn("seen_max", _from_micros(F.col("_seen")))
           .withColumn("late", (F.col("_start") + F.lit(width)) <= (F.col("_seen") - F.lit(grace_us))))
    return out.drop("_us", "_arr", "_seen", "_start")


def _chunked(r: DataFrame, partition: str, tiebreak: str, is_ts: bool, chunk: str | None, chunks: int | None) -> DataFrame:
    """``_seen`` by chunks of the arrival order: of a fixed width, or equal
    ranges of all records."""
    if chunk is None:
        n = chunks or int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # contiguous ranges of (partition, arrival, tiebreak); a range's
        # index orders it within its source partition.  Written once: both
        # branches below must see the same ranges
        r = materialize(r.repartitionByRange(n, F.col(partition), F.col("_arr"), F.col(tiebreak))
                        .withColumn("_chunk", F.spark_partition_id().cast("bigint")), "arrival-ranges")
    else:
        chunk_w = _seconds(chunk) * 1_000_000 if is_ts else int(chunk)
        r = r.withColumn("_chunk", _floor_div(F.col("_arr"), chunk_w))
    # level 1: max event time per (partition, chunk) -- a small table
    per_chunk = r.groupBy(partition, "_chunk").agg(F.max("_us").alias("_cmax"))
    # level 2: carry = max over all earlier chunks of the same partition
    carry_w = Window.partitionBy(partition).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = per_chunk.select(partition, "_chunk", F.max("_cmax").over(carry_w).alias("_carry"))
    # within a chunk: running max in arrival order
    in_w = Window.partitionBy(partition, "_chunk").orderBy("_arr", F.col(tiebreak)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    run = r.withColumn("_run", F.max("_us").over(in_w))
    seen = F.greatest(F.col("_run"), F.coalesce(F.col("_carry"), F.col("_run")))
    return (run.join(carry, [partition, "_chunk"], "left").withColumn("_seen", seen)
            .drop("_chunk", "_run", "_carry"))


def velocity_exact(records: DataFrame, key: str = "key", size: str = VELOCITY_WINDOW,
                   grace: str = VELOCITY_GRACE, threshold: int = VELOCITY_THRESHOLD,
                   **kw) -> DataFrame:
    """W1 with W8's exact lateness: counts of admitted records per window."""
    marked = drop_late(records, size=size, grace=grace, **kw)
    return (marked.where(~F.col("late"))
            .groupBy("window_start", "window_end", F.col(key).alias("key"))
            .agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") >= threshold))
