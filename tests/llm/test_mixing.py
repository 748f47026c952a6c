import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cardflow.llm import mixing as M
from tests.llm.helpers import docs_df, odd_docs, words

SF = "/root/testdata/sf0.01/documents.parquet"


def targets(sizes):
    """Targets by the definition, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        level = (left - sum(full.values())) / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            return {s: full.get(s, weight[s] * level) for s in order}
        full.update({s: 2.0 * sizes[s] for s in over})


def check(rows, docs):
    size = Counter()
    for s, n in docs:
        size[s] += n
    want = targets(size)
    assert sorted(r["size"] for r in rows) == sorted(n for _, n in docs)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert any(abs(r["target"] - t) < 1e-6 * max(1, t) for t in want.values())
    return want


def test_report(spark):
    docs = spark.read.parquet(SF)
    got = M.mix_report(docs).collect()
    sized = docs.select("doc_id", "source", M.words(F.col("text")).alias("n")).collect()
    want = check(got, [(r["source"], r["n"]) for r in sized])
    source = {r["doc_id"]: r["source"] for r in sized}
    taken, target = Counter(), {}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    for s, t in want.items():
        assert target[s] == pytest.approx(t, rel=1e-9)
        assert abs(taken[s] - t) <= 1
    again = M.mix_report(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(*r, None if i % 3 else "ß") for i, r in enumerate(odd_docs(rng))]
    rows += [(100 + i, words(rng, 300), "Z") for i in range(20)]
    got = M.mix_report(docs_df(spark, rows), block=64).collect()
    count = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    want = check(got, [(s, count(t)) for _, t, s in rows])
    by_size = defaultdict(int)
    for r in got:
        by_size[r["source_size"]] += r["taken"]
    assert sum(by_size.values()) == pytest.approx(sum(want.values()), abs=3)


def test_empty_and_no_words(spark):
    assert M.mix_report(docs_df(spark, [])).count() == 0
    got = M.mix_report(docs_df(spark, [(1, None), (2, " ")])).collect()
    assert [r["taken"] for r in got] == [0, 0] and [r["target"] for r in got] == [0.0, 0.0]


def test_schedule_is_even(spark):
    docs = spark.read.parquet(SF)
    rows = docs.select("source", M.words(F.col("text")).alias("size"))
    src = M.targets(rows)
    slots = sorted(M.schedule(src, 64).collect(), key=lambda r: r["slot"])
    quota = Counter(r["sid"] for r in slots)
    for s in quota:
        assert sorted(r["rank"] for r in slots if r["sid"] == s) == list(range(quota[s]))
    assert len({r["slot"] for r in slots}) == len(slots)
    seen = Counter()
    for i, r in enumerate(slots, 1):  # any prefix holds the sources in proportion
        seen[r["sid"]] += 1
        if i % 200 == 0:
            assert all(abs(seen[s] - quota[s] * i / len(slots)) < 8 for s in quota)


def test_bits(spark):
    got = spark.range(16).select(M.reverse_bits(F.col("id"), 4)).collect()
    assert [r[0] for r in got] == [int(f"{i:04b}"[::-1], 2) for i in range(16)]


def test_hot_source_in_slices(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_PER_SLICE", 16)
    monkeypatch.setattr(M, "CHUNK_BITS", 4)
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(0, 40)), "hot" if i % 2 else f"s{i % 7}") for i in range(400)]
    got = M.mix_report(docs_df(spark, rows), block=16).collect()
    check(got, [(s, len(t.split())) for _, t, s in rows])
    taken, want = defaultdict(int), {}
    for r in got:
        taken[r["source_size"]] += r["taken"]
        want[r["source_size"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())


def test_mix_returns_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = M.mix(docs)
    assert out.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] for r in M.mix_report(docs).collect()}
    got = Counter()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        n = len(r["text"].split())
        got[r["doc_id"]] += n
        assert text[r["doc_id"]].split()[:n] == r["text"].split()
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_no_python(spark):
    for df in (M.mix_report(spark.read.parquet(SF)), M.mix(spark.read.parquet(SF))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_the_mix_comes_in_the_order_of_its_slots(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randint(0, 40)), f"s{i % 3}") for i in range(300)]
    docs = docs_df(spark, rows)
    slot = {r["doc_id"]: r["slot"] for r in M.mix_report(docs, block=16).collect() if r["taken"]}
    assert None not in slot.values() and len(set(slot.values())) > 100
    got = [r["doc_id"] for r in M.mix(docs, block=16).collect()]
    first = list(dict.fromkeys(got))  # a repeat stands at a later slot
    assert len(got) > len(first) and set(first) == set(slot)
    assert [slot[d] for d in first] == sorted(slot.values())
