import numpy as np
from pyspark.sql import functions as F

from cardflow.llm import topk as K


def brute(rows, every, k):
    ints = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints.setdefault(i, [int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for q in ints:
        if q % every:
            continue
        s = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(ints[q], v)))), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def run(spark, rows, every=5, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    return sorted(map(tuple, K.search_embeddings(df, every, k).collect()))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 100)
    monkeypatch.setattr(K, "QUERIES", 20)
    monkeypatch.setattr(K, "GROUP", 7)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=8) / 3).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(2000, [1.0] * 3), (2005, [0.5] * 3), (2010, [0.0] * 3)]
    rows += [(3000, None), (3005, []), (3010, [float("nan")] * 8), (3015, [None] * 8), (None, [1.0] * 8),
             (3020, [float("inf")] + [0.0] * 7), (3025, [1e30] + [0.0] * 7)]
    got = run(spark, rows)
    assert got == brute(rows, 5, 5) and {r[0] for r in got if r[2] == 3025} and {r[2] for r in got if r[0] == 3025}


def test_ties_everywhere_and_few_rows(spark):
    rows = [(i, [1.0, 1.0]) for i in range(30)]
    assert run(spark, rows, 7, 3) == brute(rows, 7, 3)
    assert run(spark, rows[:3], 1, 5) == brute(rows[:3], 1, 5)
    assert run(spark, rows[:1], 1, 5) == []
    assert run(spark, []) == []


def test_repeated_rows_count_once(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(20)]
    assert run(spark, rows + rows, 5, 4) == brute(rows, 5, 4)


def test_large_values_stay_exact(spark):
    rows = [(i, [float(2.0 ** 40 + i * 2.0 ** 20), -3.0 * i, 2.0 ** 30]) for i in range(40)]
    assert run(spark, rows, 10, 5) == brute(rows, 10, 5)


def test_stops_before_the_end():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1000, size=(5000, 2))
    x[:10] = 100_000 + np.arange(10)[:, None]
    lists = K.Lists(x)
    seen = []
    old = K.Lists._best
    lists._best = lambda score, rows, k, own: (seen.append(len(rows)), old(score, rows, k, own))[1]
    got = lists.top(np.array([[1, 1], [1, 2]]), 5, np.array([-1, -1]))
    assert [r.tolist() for r, _ in got] == [[9, 8, 7, 6, 5]] * 2
    assert max(seen) < 300  # of 5000


def test_whole_table_is_ranked(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted(map(tuple, K.search_embeddings(df).collect()))
    assert got == brute(rows, 50, 5) and len(got) == 5 * df.where(F.col("vec_id") % 50 == 0).count()
