import random
import zlib

import numpy as np

from cardflow.llm import quality as Q
from cardflow.llm.hashing import WordHasher
from tests.llm.helpers import docs_df, odd_docs

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = Q.classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").collect()
    out = [r for r in got if r["held_out"]]
    assert len(out) > 500
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.98
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_scores_ignore_held_out_labels_and_other_columns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    a = {r["doc_id"]: r["score"] for r in Q.classify(docs, labels).collect()}
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - quality, quality) as quality")
    other = docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source", "0 as score", "1 as label")
    b = {r["doc_id"]: r["score"] for r in Q.classify(other.repartition(3), flipped).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-6  # sums differ with the batches


def test_odd_rows(spark):
    rows = odd_docs(random.Random(3))
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 1), (77, 0), (7, 0)], "doc_id long, quality int")
    got = Q.classify(docs_df(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    empty = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    kept = Q.keep_good(docs_df(spark, rows), labels)
    assert kept.columns == docs_df(spark, []).columns


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.classify(docs_df(spark, [(1, "a b c"), (2, None)]), none).collect()
    assert [r["score"] for r in got] == [0.5, 0.5] and [r["predicted"] for r in got] == [1, 1]
    assert Q.classify(docs_df(spark, []), none).count() == 0


def test_features_by_definition():
    texts = ["the  cat the", "", None, "cat cat\tcat", "é"]
    got = np.concatenate([c for _, c in Q.feature_counts(texts, WordHasher(), 1 << 12)])
    assert got.shape == (5, (1 << 12) + 1)
    # words, n-grams of 3 to 5 bytes inside " the ", " cat ", " the ", and no repeats
    assert got[0].sum() == 3 + 3 * (3 + 2 + 1) and got[0, -1] == 0
    assert got[1].sum() == got[2].sum() == 0
    assert got[3, -1] == 2
    # the two "the" of the first text share all their features
    only_the = np.concatenate([c for _, c in Q.feature_counts(["the", "cat"], WordHasher(), 1 << 12)])
    assert np.array_equal(got[0], 2 * only_the[0] + only_the[1])
    assert np.array_equal(got[3][:-1], 3 * only_the[1][:-1])


def test_features_do_not_depend_on_neighbours():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 3000))) for _ in range(300)] + ["w " * 1_500_000]
    whole = {}
    for first, counts in Q.feature_counts(texts, WordHasher(), 256):
        for i, c in enumerate(counts):
            whole[first + i] = c
    for i in (0, 17, 299):
        (_, one), = Q.feature_counts([texts[i]], WordHasher(), 256)
        assert np.array_equal(one[0], whole[i])
    assert whole[300][-1] >= 1_499_990


def test_training_reads_a_bounded_sample(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = Q.train(docs, labels, rows=40)
    again = Q.train(docs.repartition(4), labels.repartition(3), rows=40)
    assert np.array_equal(m.vectors, again.vectors) and np.array_equal(m.weights, again.weights)


def test_one_id_with_many_texts_stays_within_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q, "fit", lambda rows, *a, **k: seen.append(len(rows)))
    docs = docs_df(spark, [(i, f"text {k} of {i} and more") for i in range(20) for k in range(40)])
    Q.train(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int"), rows=3)
    assert seen == [3]


def test_the_sample_and_the_features_are_not_reduced():
    assert Q.TRAIN_ROWS == 3000 and Q.BUCKETS == 8192
