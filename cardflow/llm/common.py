"""Helpers shared by the corpus operators: stable row numbers, connected
components, and the block self-join that counts verified links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardflow.session import materialize

CHUNK_BITS = 16  # rows numbered together by one task in ``gapless``: 65,536


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Add a unique long per row and write the result once, so the ids are
    fixed from here on (a retried task can no longer change them)."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def gapless(df: DataFrame, group: list[str], rid: str, out: str) -> DataFrame:
    """Number the rows of each group from 0, without gaps, in ``rid`` order.

    ``df`` must be a written table whose ``rid`` came from ``with_row_id``
    and whose group columns are never null.  Two levels: rows are ranked
    within slices of 65,536 row ids, and a slice starts where the slices
    before it end.  So a group of any size spreads over many tasks.
    """
    chunk = "__chunk"
    rows = df.withColumn(chunk, F.shiftright(rid, CHUNK_BITS))
    counts = rows.groupBy(*group, chunk).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, chunk,
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy(*group, chunk).orderBy(rid)) - 1
    return (rows.withColumn("__rank", rank)
            .join(starts, [*group, chunk])
            .withColumn(out, (F.col("__start") + F.col("__rank")).cast("long"))
            .drop(chunk, "__rank", "__start"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v: longs, u != v, no nulls).

    Returns (id, component): every node of an edge with the smallest id it
    reaches.  Alternates the large-star and small-star steps until nothing
    changes; each round is two aggregations and joins over the edges and is
    written to the shared folder, so lineage stays short and no component
    is ever gathered in one place.  Only counts reach the driver.
    """
    def star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: every node's lower neighbours, and itself, meet at the lowest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        return (near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                .union(near.select("u", F.col("m").alias("v"))).distinct())

    cur = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges")
    seen = None
    while True:
        mark = cur.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
        cur = materialize(star(cur), "edges")
    return (cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .union(cur.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())


def uniform(seed: str, *cols: Column) -> Column:
    """A draw in (0, 1) decided by the columns' values and ``seed``."""
    h = F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11)
    return (h.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
