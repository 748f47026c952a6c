"""The registered corpus queries and the pipeline, on the driver's tables."""

import pytest

import corpus_pipeline
from cardflow.llm import ngram_join, quality
from cardflow.llm import queries as C
from tests.conftest import SF001
from tests.oracle import compare, duck

import __spark_entry__ as E


def test_all_are_registered():
    names = set(E.queries())
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(C.oracle_sql()))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_oracle(spark, sf, name):
    r = compare(spark, sf, name, E.queries()[name], C.oracle_sql()[name], duck(sf))
    assert r["ok"], r


@pytest.mark.parametrize("name,table", [("op1_embed_dedup", "embeddings"), ("op2_shard_tree", "documents"),
                                        ("op5_mix_sources", "documents"), ("op8_secret_scan", "documents"), ("op11_periodic_runs", "documents"),
                                        ("op9_ngram_join", "documents"), ("op10_quality", "documents"),
                                        ("op4_arc_warc", "pages"), ("op7_url_filter", "pages")])
def test_a_row_for_every_row(spark, name, table):
    df = E.queries()[name](spark, SF001)
    assert df.count() == spark.read.parquet(f"{SF001}/{table}.parquet").count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = docs.columns
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF001), "stage-test")
        kept[name] = docs
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
    whole = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet").select("doc_id", "quality")
    good = {r["doc_id"] for r in quality.classify(whole, labels).collect() if r["predicted"] == 1}
    assert {r["doc_id"] for r in kept["quality classifier"].collect()} == good
    one = {r["doc_id"] for r in ngram_join.jaccard_join(kept["quality classifier"]).collect() if r["kept"]}
    assert sorted(r["doc_id"] for r in kept["n-gram Jaccard join"].collect()) == sorted(one)
    assert kept["secret scans"].count() == len(one)
    words = {r["doc_id"]: len(r["text"].split()) for r in kept["secret scans"].collect()}
    mixed = {}
    for r in kept["mixing sources"].collect():
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + len(r["text"].split())
    assert all(0 < n <= 2 * words[d] for d, n in mixed.items())
    assert abs(sum(mixed.values()) - 1.5 * sum(words.values())) < 25
    packed = kept["packing"].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in packed) <= 4096


def test_run_equals_stages_by_turns(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
