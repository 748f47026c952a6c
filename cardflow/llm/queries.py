"""The registered corpus queries: each applies one operator, with its
production parameters, to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflow.llm import (
    arc_warc, best_two_fit, conversation_repair, embed_dedup, mixing, ngram_join, packing,
    periodic_runs, quality, secret_scan, shard_tree, topk, url_rules,
)
from cardflow.sources.tables import table

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def tokenizer_path() -> str:
    """The tokenizer of the registered packing query."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_embed_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op2_shard_tree")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = shard_tree.layout(docs, shard_tree.tree(8))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op3_topk_search")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


@query("op4_arc_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arc_warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_mix_sources")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query("op6_bm25_pack")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_report(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op7_url_filter", url_rules.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, url_rules.rules_table(spark))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


@query("op9_ngram_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


@query("op10_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"),
                            table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair", conversation_repair.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))


@query("op13_best_two_fit")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit.pack_report(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
