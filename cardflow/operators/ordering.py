"""Row numbers of a sorted table without one task holding it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardflow.session import materialize

_ROW = (1 << 33) - 1  # the row's part of monotonically_increasing_id


def numbered(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with its position (from 1) by the columns of ``order``, which
    must make the order total.

    The rows are sorted by range and written with their range and place in
    it; a range starts where the ranges before it end, so only the table of
    ranges is summed in one place.
    """
    rows = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_range", F.shiftright("_id", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit(_ROW)) + 1
    return rows.join(starts, "_range").withColumn(name, place.cast("long")).drop("_id", "_range", "_start")
