import random
import zlib

import numpy as np
import pytest

from cardflow.llm import packing as P
from cardflow.llm.queries import tokenizer_path
from tests.llm.helpers import docs_df, odd_docs, words


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(pieces, rows, tokenizer, window):
    """Every id of every document lies in exactly one piece, windows are
    gapless and hold at most ``window`` ids."""
    want = sorted(((r[0], tuple(ids_of(tokenizer, r[1]))) for r in rows), key=str)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    total = {}
    for d, t in want:
        total[d, len(t)] = total.get((d, len(t)), 0) + 1
    assert {k: sum(p["length"] for p in v) for k, v in by_doc.items()} == {k: k[1] * n for k, n in total.items()}
    unique = {k for k, n in total.items() if n == 1}
    for d, t in want:
        if (d, len(t)) not in unique:
            continue
        at = 0
        for p in sorted(by_doc[d, len(t)], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(np.array(t[at:at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(t)
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return [sum(p["length"] for p in ps) for ps in by_seq.values()]


def test_pieces(spark, tokenizer):
    rng = random.Random(1)
    rows = odd_docs(rng) + [(100 + i, words(rng, rng.randint(0, 400))) for i in range(150)]
    fill = check(P.pack_report(docs_df(spark, rows).coalesce(1), tokenizer_path(), window=256).collect(), rows, tokenizer, 256)
    assert sum(n < 256 for n in fill) <= 2


def test_shards_share_windows(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "SHARD_DOCS", 10)
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(0, 100))) for i in range(95)]
    fill = check(P.pack_report(docs_df(spark, rows).coalesce(1), tokenizer_path(), window=128).collect(), rows, tokenizer, 128)
    assert sum(n < 128 for n in fill) <= 1


def test_empty(spark):
    assert P.pack_report(docs_df(spark, []), tokenizer_path()).count() == 0


def test_word_tokenizer_equals_the_tokenizer(tokenizer, spark):
    rng = random.Random(3)
    alphabet = "aAbBzZéÉßÿÜ'’.,!?-_*&%$#()12 3½  \x1c\x85Σςİıǅ一二😀é̈ﬁ<|>\t\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["don't we'll I'M x's", "<|endoftext|> a<|startoftext|>b", "Ωmega ΑΣ ΑΣ.", "", "a" * 5000, "Hello,World!! ***", "nul\x00byte"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    t = P.WordTokenizer(tokenizer_path())
    got = list(t.encode([x.encode() for x in texts]))
    for x, g in zip(texts, got):
        assert np.frombuffer(g, t.kind).tolist() == tokenizer.encode(x, add_special_tokens=False).ids, x


def test_cache_is_bounded_and_forgets_safely(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 50)
    rng = random.Random(4)
    texts = [words(rng, 30) for _ in range(1500)]
    t = P.WordTokenizer(tokenizer_path())
    assert [np.frombuffer(g, t.kind).tolist() for g in t.encode([x.encode() for x in texts])] == [
        tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_statistics_cover_all_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.collect()]
    idf, average = P.statistics(P.tokenize(docs.repartition(4), tokenizer_path()))
    ids = [ids_of(tokenizer, t) for t in texts]
    df = {}
    for i in ids:
        for t in set(i):
            df[t] = df.get(t, 0) + 1
    assert average == pytest.approx(sum(map(len, ids)) / len(ids))
    for t, n in df.items():
        assert idf[t] == pytest.approx(np.log1p((len(ids) - n + 0.5) / (n + 0.5)), rel=1e-5)
    assert np.count_nonzero(idf) == len(df)


def test_index_scores_equal_bm25():
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 30, rng.integers(1, 40)).astype("<u2") for _ in range(25)]
    idf = rng.random(30).astype(np.float32)
    average = np.mean([len(i) for i in ids])
    index = P.Index(ids, idf, average)
    query = np.array([3, 3, 7, 11])
    for d, s in enumerate(index.scores(query)):
        tf = np.array([(ids[d] == t).sum() for t in (3, 7, 11)])
        w = idf[[3, 7, 11]] * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(ids[d]) / average))
        assert s == pytest.approx(w.sum(), rel=1e-4)


def test_neighbours_fill_the_seeds_window():
    topic = lambda k: np.arange(k * 10, k * 10 + 10)
    ids = [np.tile(topic(k), 3).astype("<u2") for k in (0, 1, 2, 0, 1, 2, 0, 1, 2)]
    packer = P.Packer(90, np.ones(40, dtype=np.float32), 30.0, 0)
    out = packer.shard(list(range(9)), ids)
    for s, d in out.groupby("sequence_id")["doc_id"]:
        assert len({x % 3 for x in d}) == 1


def test_all_terms_of_a_long_seed_count():
    rng = np.random.default_rng(6)
    ids = [rng.integers(0, 2000, rng.integers(1, 900)).astype("<u2") for _ in range(40)]
    ids += [np.array([1990 + i]).astype("<u2") for i in range(9)]  # one term each
    idf = rng.random(2000).astype(np.float32) + 0.01
    average = np.mean([len(i) for i in ids])
    index = P.Index(ids, idf, average)
    seed = np.concatenate([np.arange(600), np.arange(1990, 1999)])

    def brute(d):
        out = 0.0
        for t in set(seed.tolist()):
            tf = (ids[d] == t).sum()
            out += idf[t] * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(ids[d]) / average))
        return out

    want = np.array([brute(d) for d in range(len(ids))])
    assert index.scores(seed) == pytest.approx(want, rel=1e-4) and (want[40:] > 0).all()
    wanted = rng.random(len(ids)) < 0.4
    index.keep(wanted)
    assert index.docs.tolist() == np.flatnonzero(wanted).tolist()
    assert index.scores(seed) == pytest.approx(want[wanted], rel=1e-4)


def test_related_documents_meet_wherever_the_table_has_them(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_DOCS", 10)
    topics = ["apple orchard cider", "harbor vessel anchor", "violin sonata cello", "glacier summit ridge"]
    rows = [(i, " ".join([topics[i % 4]] * 14)) for i in range(40)]  # every run of 10 rows holds all topics
    docs = docs_df(spark, rows).repartition(4, "doc_id")
    tokens = P.tokenize(docs, tokenizer_path())
    order = [r["doc_id"] % 4 for r in P.routed(tokens, P.statistics(tokens)[0], 2).coalesce(1).collect()]
    assert sum(a != b for a, b in zip(order, order[1:])) == 3
    got = P.pack_report(docs, tokenizer_path(), window=128).collect()
    alike = {}
    for r in got:
        alike.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 4)
    assert sum(len(v) > 1 for v in alike.values()) <= 3
