"""Loading the driver's parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from cardflow.session import path_exists

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale-factor folder (``<sf_dir>/<name>.parquet``)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register the tables that exist as temp views so ``spark.sql`` can
    query them."""
    for n in names or TABLES:
        path = os.path.join(sf_dir, f"{n}.parquet")
        if path_exists(spark, path):
            table(spark, sf_dir, n).createOrReplaceTempView(n)
