import random

from pyspark.sql import functions as F

from cardflow.llm.common import components, gapless, with_row_id


def brute(edges):
    nodes = {x for e in edges for x in e}
    low = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            m = min(low[u], low[v])
            changed |= low[u] != m or low[v] != m
            low[u] = low[v] = m
    return low


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)]  # a long path
    edges += [(500, 501 + i) for i in range(80)]  # a star
    edges += [(a, b) for a, b in ((rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)) if a != b]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_gapless_numbers_each_group(spark, monkeypatch):
    import cardflow.llm.common as C
    monkeypatch.setattr(C, "CHUNK_BITS", 3)
    df = with_row_id(spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("g")), "rid")
    rows = gapless(df, ["g"], "rid", "n").collect()
    for g in (0, 1):
        assert sorted(r["n"] for r in rows if r["g"] == g) == list(range(sum(r["g"] == g for r in rows)))
