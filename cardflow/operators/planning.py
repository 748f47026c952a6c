"""Capacity and storage planning over measured tables.

The planning formulas take measured inputs (arrival rate and latency
per time bucket; daily volume and row size per merchant) and return one
row per group.  Model and tier tables are a few fixed rows, attached
with ``inline`` (a generator), not a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.constants import (
    MODEL_ASYNC, MODEL_PLATFORM, MODEL_VIRTUAL, PLAN_BUFFER_PCT, PLAN_HEAP_MB,
    PLAN_MEM_PER_REQUEST_MB, PLAN_THREAD_POOL, STORAGE_COPIES, STORAGE_GROWTH_PCT,
    STORAGE_INDEXES, STORAGE_YEARS, TIER_PRICES,
)


def concurrency(scored: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """In-flight requests per arrival bucket by Little's law.

    throughput = arrivals / bucket seconds; latency = mean(scored_at -
    arrival) in ms over rows scored after arrival; concurrency =
    throughput x latency / 1000.
    """
    secs = _bucket_seconds(bucket)
    lat_ms = F.timestamp_diff("MICROSECOND", F.col("arrival"), F.col("scored_at")) / F.lit(1000.0)
    b = F.window("arrival", bucket).start.cast("timestamp_ntz")
    g = (scored.select(b.alias("bucket"), F.when(lat_ms >= 0, lat_ms).alias("lat_ms"))
         .groupBy("bucket")
         .agg(F.count(F.lit(1)).alias("arrivals"), F.avg("lat_ms").alias("latency_ms")))
    return g.select("bucket", "arrivals",
                    (F.col("arrivals") / F.lit(float(secs))).alias("throughput"),
                    "latency_ms",
                    (F.col("arrivals") / F.lit(float(secs)) * (F.col("latency_ms") / 1000.0))
                    .alias("concurrency"))


def _bucket_seconds(bucket: str) -> int:
    from cardflow.operators.velocity import _seconds
    return _seconds(bucket)


def default_models(thread_pool: int = PLAN_THREAD_POOL, heap_mb: float = PLAN_HEAP_MB,
                   mem_mb: float = PLAN_MEM_PER_REQUEST_MB) -> list[tuple[str, int]]:
    """Capacity per instance: thread pool, or heap / memory per request."""
    import math
    mem_cap = int(math.floor(heap_mb / mem_mb))
    return [(MODEL_PLATFORM, thread_pool), (MODEL_VIRTUAL, mem_cap), (MODEL_ASYNC, mem_cap)]


def instances(conc: DataFrame, models: list[tuple[str, int]] | None = None,
              buffer_pct: int = PLAN_BUFFER_PCT) -> DataFrame:
    """Instances per model and bucket.

    raw = ceil(concurrency / capacity); with_buffer = ceil(raw x (1 +
    buffer/100)); the first model is the baseline for reduction_pct
    (rounded) and ratio (baseline / model, one decimal).
    """
    models = models or default_models()
    arr = F.array(*[F.struct(F.lit(i).alias("model_rank"), F.lit(n).alias("model"),
                             F.lit(c).alias("capacity")) for i, (n, c) in enumerate(models)])
    base_cap = models[0][1]
    factor = 1 + buffer_pct / 100.0

    def with_buffer(cap):
        raw = F.ceil(F.col("concurrency") / F.lit(float(cap)))
        return F.ceil(raw * F.lit(factor))

    x = conc.select("bucket", "concurrency", F.inline(arr),
                    with_buffer(base_cap).cast("bigint").alias("base_with_buffer"))
    raw = F.ceil(F.col("concurrency") / F.col("capacity").cast("double")).cast("bigint")
    wb = F.ceil(raw * F.lit(factor)).cast("bigint")
    return x.select(
        "bucket", "model_rank", "model", "capacity", raw.alias("raw"), wb.alias("with_buffer"),
        F.when(F.col("base_with_buffer") > 0,
               F.round((1 - wb / F.col("base_with_buffer")) * 100)).otherwise(0)
         .cast("bigint").alias("reduction_pct"),
        F.when(wb > 0, F.round(F.col("base_with_buffer") / wb, 1)).alias("ratio"),
    )


def daily_volume(rows: DataFrame, day_col: str, size_col: str, group: str = "merchantId") -> DataFrame:
    """Mean rows per day and mean row size in KB per group (C3 input)."""
    per_day = (rows.groupBy(group, F.col(day_col).cast("date").alias("day"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum(size_col).alias("bytes")))
    return per_day.groupBy(group).agg(
        (F.sum("n") / F.count(F.lit(1))).alias("daily_items"),
        (F.sum("bytes") / F.sum("n") / 1024.0).alias("item_kb"))


def storage_projection(daily: DataFrame, years: int = STORAGE_YEARS,
                       growth_pct: float = STORAGE_GROWTH_PCT, indexes: int = STORAGE_INDEXES,
                       copies: int = STORAGE_COPIES) -> DataFrame:
    """Projected items and GB per group.

    items = sum over years y < years of daily x 365 x (1 + growth)^y;
    raw_gb = items x kb / 1024^2; total_gb = raw_gb x (1 + indexes) x copies.
    The year factor is a constant of the parameters, folded on the driver.
    """
    factor = sum((1 + growth_pct / 100.0) ** y for y in range(years))
    items = F.col("daily_items") * F.lit(365.0) * F.lit(factor)
    raw_gb = items * F.col("item_kb") / F.lit(1024.0 * 1024.0)
    total = raw_gb * F.lit(float((1 + indexes) * copies))
    keep = [c for c in daily.columns if c not in ("daily_items", "item_kb")]
    return daily.select(*keep, "daily_items", "item_kb", items.alias("total_items"),
                        raw_gb.alias("raw_gb"), total.alias("total_gb"),
                        format_gb(total).alias("total_label"))


def format_gb(gb) -> F.Column:
    """GB / TB / PB with two decimals."""
    return (F.when(gb >= 1024.0 * 1024.0, F.format_string("%.2f PB", gb / (1024.0 * 1024.0)))
            .when(gb >= 1024.0, F.format_string("%.2f TB", gb / 1024.0))
            .otherwise(F.format_string("%.2f GB", gb)))


def tier_costs(projection: DataFrame, tiers: list[tuple[str, float]] | None = None) -> DataFrame:
    """Monthly cost per tier and group, saving vs the first tier (C4)."""
    tiers = tiers or TIER_PRICES
    arr = F.array(*[F.struct(F.lit(i).alias("tier_rank"), F.lit(n).alias("tier"),
                             F.lit(p).alias("price_gb_month")) for i, (n, p) in enumerate(tiers)])
    base = tiers[0][1]
    keep = [c for c in projection.columns if c not in ("total_label",)]
    x = projection.select(*keep, F.inline(arr))
    cost = F.col("total_gb") * F.col("price_gb_month")
    base_cost = F.col("total_gb") * F.lit(base)
    return x.select(
        *[c for c in keep if c in ("merchantId",)], "total_gb", "tier_rank", "tier", "price_gb_month",
        cost.alias("monthly_cost"),
        F.when(F.col("tier_rank") == 0, F.lit(None).cast("bigint"))
         .otherwise(F.round((1 - cost / base_cost) * 100).cast("bigint")).alias("saving_pct"),
        F.when(cost >= 1000, F.concat(F.lit("$"), F.format_number(F.round(cost, 0), 0)))
         .otherwise(F.format_string("$%.2f", cost)).alias("cost_label"),
    )
