import random

import numpy as np
import pytest

from cardflow.llm import ngram_join as N
from cardflow.llm import pairs
from cardflow.llm.hashing import WordHasher, encode
from tests.llm.helpers import docs_df, odd_docs, words


def shingles(text, n=5):
    w = (text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(rows, threshold=0.8):
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    adj = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * len(sets[i] | sets[j]):
                adj[i].add(j)
                adj[j].add(i)
    out = []
    ids = lambda ks: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None)
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in adj[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        same = [k for k in range(n) if rows[k][1] and r[1] and rows[k][1].encode().split() == r[1].encode().split() and sets[i]] or [i]
        c = ids(seen)
        out.append((r[0], ids(same), len(adj[i]), c, c == r[0] if c is not None and r[0] is not None else False))
    return sorted(out, key=str)


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = "new" + str(rng.random())
    return " ".join(w)


def sample(rng):
    rows = odd_docs(rng)
    base = [words(rng, n) for n in (6, 30, 80, 200, 400, 3000)]
    k = 100
    for b in base:
        for e in (0, 1, 1, 2, 3, 8, 20):
            rows.append((k, edited(rng, b, e)))
            k += 1
    hot = words(rng, 150)
    rows += [(k + i, edited(rng, hot, 1)) for i in range(60)] + [(k + 100 + i, hot) for i in range(40)]
    passage = words(rng, 40)
    rows += [(k + 200 + i, f"{words(rng, 60)} {passage} {words(rng, 60)}") for i in range(30)]
    return rows


@pytest.mark.parametrize("chunk", [1024, 16])
def test_links_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(pairs, "CHUNK", chunk)
    rows = sample(random.Random(chunk))
    got = N.jaccard_join(docs_df(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty(spark):
    assert N.jaccard_join(docs_df(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(9)
    rows = sample(rng)
    kept = N.drop_near_duplicates(docs_df(spark, rows))
    want = {r[0] for r in brute(rows) if r[4]}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(g for g in got if g is not None) == sorted(want) and got.count(None) == 2
    assert kept.columns == docs_df(spark, []).columns


def test_rows_are_judged_by_their_texts(spark):
    t, u, v = "a b c d e f g h i j k l m n", "another text of its own that nobody copies at all", "third x y z w q r s t u v"
    rows = [(1, t), (2, t), (2, u), (3, v), (3, v), (None, t + " o"), (None, v), (None, "alone here with five words"), (4, None), (4, "")]
    kept = sorted(((r["doc_id"], r["text"]) for r in N.drop_near_duplicates(docs_df(spark, rows).repartition(3)).collect()), key=str)
    assert kept == sorted([(1, t), (2, u), (3, v), (None, "alone here with five words"), (4, None), (4, "")], key=str)


def test_bands_reach_the_recall():
    assert 1 - (1 - 0.8 ** N.ROWS) ** N.bands() >= N.RECALL
    assert N.bands(0.9, 10, 0.99) < N.bands(0.8, 10, 0.99)


def test_hashes_do_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [words(rng, n) for n in (0, 1, 4, 5, 6, 1000, 50_000)] + ["y" * (5 << 20), " "]
    h = WordHasher()
    whole, counts = h.words(encode(texts))
    assert counts.tolist() == [len(t.split()) for t in texts]
    at = 0
    for t, c in zip(texts, counts):
        one, _ = WordHasher().words(encode([t]))
        assert np.array_equal(one, whole[at:at + c])
        at += c
    assert len(set(whole.tolist())) == len({w for t in texts for w in t.split()})


def test_accept_jaccard_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype("<u8")) for _ in range(40)]
    got = N.accept_jaccard(0.5)([s.tobytes() for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if i != j:
                assert got[i, j] == (both > 0 and 2 * both >= len(np.union1d(a, b)))
            if j == i + 1:
                assert N.accept_jaccard(0.5)([a.tobytes(), b.tobytes()])[0, 1] == got[i, j]


def test_runs_span_batches():
    import pandas as pd
    rows = pd.DataFrame({"key": [1, 1, 1, 2, 3, 3], "lo": 0, "hi": 0, "x": range(6)})
    for cut in range(1, 6):
        runs = list(pairs._blocks(iter([rows[:cut], rows[cut:cut], rows[cut:]])))
        assert [r["x"].tolist() for r in runs] == [[0, 1, 2], [3], [4, 5]]
