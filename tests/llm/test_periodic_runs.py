import hashlib
import random
import zlib

import numpy as np
import pytest

from cardflow.llm import periodic_runs as R
from cardflow.llm.hashing import WordHasher
from tests.conftest import SF001
from tests.llm.helpers import docs_df, odd_docs


def brute(x):
    """Runs by definition: every period, every maximal stretch."""
    out = []
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            n = j + p - i
            if n >= max(6, 4 * p) and not any(x[i:i + n - q] == x[i + q:i + n] for q in range(1, p)):
                out.append((i, n, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(rng):
    k = rng.choice([1, 2, 2, 3, 5, 40])
    x = [rng.randrange(k) for _ in range(rng.randint(0, 40))]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.randrange(k + 1) for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(x))
        x[at:at] = (unit * 12)[:rng.randint(0, 60)]
    return x


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        x = sequence(rng)
        assert R.runs_of(x) == brute(x), x


def test_stretches_lose_no_run():
    rng = random.Random(9)
    seqs = [sequence(rng) for _ in range(300)]
    texts = [b" ".join(b"w%d" % v for v in x) for x in seqs]
    for x, (words, runs) in zip(seqs, R.find(texts, WordHasher())):
        assert len(words) == len(x) and runs == brute(x)


def test_all_automaton_agrees_with_the_stretches():
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["the", "of", "a", "and", f"x{i % 7}"]) for i in range(3000)).encode() for _ in range(5)]
    for t, (words, runs) in zip(texts, R.find(texts, WordHasher())):
        assert runs == R.runs_of(words)


def test_long_texts_cost_little_more_than_their_length():
    a, b = ["a"], ["a", "b"]
    while len(b) < 50_000:  # as many squares as a text can hold, none of four periods
        a, b = b, b + a
    assert R.runs_of(b) == []
    assert R.runs_of([1] * 60_000) == [(0, 60_000, 1)]
    assert R.runs_of(list(range(500)) * 100 + [1, 2]) == [(0, 50_000, 500)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + int((n - a) / (3 + g % 8))
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = set()
    for s, n, p in runs:
        dropped.update(range(s + p, s + n))
    top = sorted(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))[0] if runs else (None, None, None)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def key(r):
    return tuple((x is not None, x) for x in r)


def test_report_against_brute_force(spark):
    rng = random.Random(4)
    rows = [r for r in odd_docs(rng) if not r[1] or len(r[1]) < 5000 or len(r[1].split()) == 1]
    rows += [(100 + i, " ".join(f"w{v}" for v in sequence(rng))) for i in range(300)]
    rows += [(None, "a b " * 20), (None, "a b " * 20), (7, "\x0b x y x y\tx y x y\r\n x y x y")]
    got = sorted((tuple(r) for r in R.run_report(docs_df(spark, rows).repartition(3)).collect()), key=key)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 100


def test_driver_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("n_chars < 4000")
    got = sorted(tuple(r) for r in R.run_report(docs).collect())
    assert got == sorted(expected(r["doc_id"], r["text"]) for r in docs.collect())


def test_remove_repeats(spark):
    rows = [(1, "so a b a b  a b a b\na b. end"), (2, None), (3, "spam " * 9), (3, "no run here"), (None, "")]
    got = {(r["doc_id"], tuple(tuple(x) for x in r["runs"]), r["text"]) for r in R.remove_repeats(docs_df(spark, rows)).collect()}
    assert got == {(1, ((1, 9, 2),), "so a b b. end"), (2, (), ""), (3, ((0, 9, 1),), "spam"), (3, (), "no run here"),
                   (None, (), "")}
    again = R.remove_repeats(R.remove_repeats(docs_df(spark, rows)).select("doc_id", "text"))
    assert all(not r["runs"] for r in again.collect())


def test_empty(spark):
    assert R.run_report(docs_df(spark, [])).count() == 0
    assert R.stretches(np.zeros(0, np.uint64), np.zeros(0, np.int64))[0].size == 0
