import random
import zlib

import numpy as np
import pytest

from cardflow.llm import best_two_fit as B
from cardflow.llm.queries import tokenizer_path
from tests.llm.helpers import docs_df, odd_docs, words


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def one_by_one(lengths, window):
    """Best-two-fit over single pieces, a sequence at a time."""
    left = sorted(lengths)
    out = []
    while left:
        bin_, room = [], window
        while fits := [x for x in left if x <= room]:
            bin_.append(fits[-1])
            left.remove(fits[-1])
            room -= fits[-1]
        if room and len(bin_) > 1:
            small = min(bin_)
            pairs = [(left[i] + left[j], left[j], left[i]) for i in range(len(left)) for j in range(i + 1, len(left))
                     if small < left[i] + left[j] <= room + small]
            if pairs:
                _, a, b = max(pairs)
                left.remove(a), left.remove(b)
                bin_.remove(small)
                bin_ += [a, b]
                left = sorted(left + [small])
        out.append(tuple(sorted(bin_, reverse=True)))
    return out


@pytest.mark.parametrize("seed", range(25))
def test_plan_equals_one_by_one(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 2, 7, 20, 50, 101])
    kinds = [rng.randint(1, window) for _ in range(rng.randint(1, 12))]
    lengths = [rng.choice(kinds) if rng.random() < .7 else rng.randint(1, window) for _ in range(rng.randint(0, 120))]
    lines = B.plan(np.bincount(lengths, minlength=window + 1) if lengths else np.zeros(window + 1, dtype=int), window)
    got = [tuple(x for x, n in content for _ in range(n)) for bins, content in lines for _ in range(bins)]
    assert got == one_by_one(lengths, window)


def test_the_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.geometric(0.004, 200_000), 2048), minlength=2049)
    small, large = B.plan(counts, 2048), B.plan(counts * 1_000_003, 2048)
    total = int((np.arange(2049) * counts).sum())
    assert sum(n for n, _ in small) <= -(-total // 2048) * 1.001 + 1
    assert sum(n for n, _ in large) <= -(-total * 1_000_003 // 2048) * 1.001 + 1
    assert len(large) < 2048 * 8


def check(pieces, rows, tokenizer, window):
    want = {}
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), window)):
            x = (d, k, at, len(ids[at:at + window]), zlib.crc32(np.array(ids[at:at + window], dtype="<u4").tobytes()))
            want[x] = want.get(x, 0) + 1
    got, by_seq = {}, {}
    for p in pieces:
        x = (p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"])
        got[x] = got.get(x, 0) + 1
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert got == want
    for ps in by_seq.values():
        at = 0
        for offset, n in sorted(ps):
            assert offset == at
            at += n
        assert at <= window
    assert sorted(by_seq) == list(range(len(by_seq)))
    return [tuple(sorted((n for _, n in ps), reverse=True)) for ps in by_seq.values()]


@pytest.mark.parametrize("parts", [1, 5])
def test_pieces_and_filling(spark, tokenizer, parts):
    rng = random.Random(2)
    rows = [(r[0], r[1]) for r in odd_docs(rng)] + [(100 + i, words(rng, rng.randint(0, 120))) for i in range(150)]
    rows += [(1000 + i, "the same words again") for i in range(90)]
    docs = docs_df(spark, rows).repartition(parts)
    bins = check(B.pack_report(docs, tokenizer_path(), window=128).collect(), rows, tokenizer, 128)
    assert sorted(bins) == sorted(one_by_one([n for b in bins for n in b], 128))


def test_ids_are_whole(spark, tokenizer):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(0, 200))) for i in range(40)]
    got = {}
    for p in B.pack(docs_df(spark, rows), tokenizer_path(), window=64).collect():
        got.setdefault(p["doc_id"], []).append((p["piece"], p["ids"]))
    for d, t in rows:
        ids = b"".join(x for _, x in sorted(got[d]))
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [0]


def test_empty(spark):
    out = B.pack_report(docs_df(spark, []), tokenizer_path())
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() == 0


def test_driver_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    bins = check(B.pack_report(docs, tokenizer_path()).collect(), rows, tokenizer, 2048)
    assert len(bins) <= -(-sum(map(sum, bins)) // 2048) + 1
