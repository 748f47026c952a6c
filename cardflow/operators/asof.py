"""Ordered runs: what stood before a row, without joining pairs.

Two kinds of rows of one key (feed entries and the actions on them, attempts
and the status events before them) are put together in one order, and a
running value passes from one kind to the other.  That is one shuffle by the
key and one sort, linear in both sides, where a join would meet every row of
one side with every row of the other.

A key with more rows than a task should hold is cut by rows: the rows of all
such keys are sorted by range over (key, order), a range is a slice, the running
value is taken within (key, slice), and what earlier slices hold is carried in
from a table of a row per key and slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cardflow.operators.skew import HOT_KEY_ROWS
from cardflow.session import materialize

Running = Callable[[WindowSpec], Column]


def running(rows: DataFrame, key: str, order: list, out: str, value: Running, per_slice: Column,
            carry: Running, merge: Callable[[Column, Column], Column],
            hot_rows: int = HOT_KEY_ROWS) -> list[DataFrame]:
    """``rows`` with ``out``: ``value`` over the rows of the key up to this
    one, in ``order`` (columns, total).

    Returns one DataFrame with the rows of keys of at most ``hot_rows`` rows,
    partitioned by the key, and, if there are larger ones, one with theirs.
    For those ``per_slice`` aggregates a slice as ``_part``, ``carry`` folds
    the ``_part`` of the slices before (NULL if there are none), and ``merge``
    joins that with the value within the slice.
    """
    upto = (Window.unboundedPreceding, Window.currentRow)
    small = Window.partitionBy(key).orderBy(*order).rowsBetween(*upto)
    # counted by a hash of the key first, so that a long is shuffled per key
    # and not the key; only keys of hashes that are hot are counted themselves
    digest = F.xxhash64(key)
    many = F.col("_n") > hot_rows
    digests = materialize(rows.groupBy(digest.alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where(many).select("_hash"),
                          "hot-hashes")
    if not digests.limit(1).count():
        return [rows.withColumn(out, value(small))]
    hot = materialize(rows.join(digests, digest == F.col("_hash"), "left_semi").groupBy(key)
                      .agg(F.count(F.lit(1)).alias("_n")).where(many).select(key), "hot-keys")
    cold = rows.join(hot, key, "left_anti").select(*rows.columns).withColumn(out, value(small))
    # written once: both uses below must see the same slices
    sliced = materialize(rows.join(hot, key, "left_semi").repartitionByRange(key, *order)
                         .withColumn("_slice", F.spark_partition_id()), "slices")
    parts = sliced.groupBy(key, "_slice").agg(per_slice.alias("_part"))
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(key, "_slice", carry(earlier).alias("_before"))
    within = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(*upto)
    large = (sliced.withColumn(out, value(within)).join(before, [key, "_slice"])
             .withColumn(out, merge(F.col("_before"), F.col(out))).select(*rows.columns, out))
    return [cold, large]


def union_all(branches: list[DataFrame]) -> DataFrame:
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out
