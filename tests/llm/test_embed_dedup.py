import numpy as np

from cardflow.llm import embed_dedup as D
from cardflow.llm import pairs

SCHEMA = "vec_id long, embedding array<float>, label int, id long, keys string"


def brute(rows, threshold=D.THRESHOLD):
    unit = D.usable([r[1] for r in rows])
    n = len(rows)
    adj = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if unit[i] is None or unit[j] is None or rows[i][2] is None or rows[i][2] != rows[j][2]:
                continue
            if len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold:
                adj[i].add(j)
                adj[j].add(i)
    low = [r[0] for r in rows]
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in adj[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        low[i] = min(rows[k][0] for k in seen)
    return sorted((r[0], len(a), c, c == r[0]) for r, a, c in zip(rows, adj, low))


def near(x, cos, rng):
    n = rng.normal(size=len(x))
    n -= (n @ x) * x
    return cos * x + np.sqrt(1 - cos * cos) * n / np.linalg.norm(n)


def vectors(rng, n, d=64):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def sample(rng):
    rows, k = [], 0
    for i, x in enumerate(vectors(rng, 60)):
        label = i % 4
        rows.append((k, x.astype(np.float32).tolist(), label))
        k += 1
        for cos in (0.999, 0.97, 0.95, 0.90):
            if i % 3 == 0:
                rows.append((k, near(x, cos, rng).astype(np.float32).tolist(), label if cos != 0.97 else (label + i % 2) % 4))
                k += 1
    x = vectors(rng, 1)[0]
    for _ in range(150):  # one large group of near copies
        rows.append((k, near(x, 0.98, rng).astype(np.float32).tolist(), 9))
        k += 1
    for _ in range(40):  # and of exact copies
        rows.append((k, x.astype(np.float32).tolist(), 9))
        k += 1
    rows += [(k, [0.0] * 64, 1), (k + 1, [0.0] * 64, 1), (k + 2, None, 1), (k + 3, [float("nan")] * 64, 1),
             (k + 4, [float("inf")] + [0.0] * 63, 1), (k + 5, [None] + [1.0] * 63, 1), (k + 6, [], 1),
             (k + 7, [1.0, 2.0], 1), (k + 8, [2.0, 4.0], 1), (k + 9, [1.0, 2.0], None), (k + 10, [1.0, 2.0], None),
             (k + 11, [1.0, 2.0, 0.0], 1), (k + 12, [3.0], 2), (k + 13, [1e30], 2), (k + 14, [-3.0], 2)]
    return rows


def test_links_match_brute_force(spark):
    rows = sample(np.random.default_rng(1))
    got = D.near_duplicates(spark.createDataFrame([(*r, -1, "k") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_large_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 20)
    rows = sample(np.random.default_rng(2))
    got = D.near_duplicates(spark.createDataFrame([(*r, -1, "k") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_repeated_rows_and_empty(spark):
    row = (1, [1.0, 0.0], 3, 0, "k")
    got = D.near_duplicates(spark.createDataFrame([row, row], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, True)] * 2
    assert D.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    x = vectors(rng, 3000)
    y = np.stack([near(v, 0.93, rng) for v in x])
    label = np.zeros(len(x), dtype=np.int64)
    a, b = D.bucket_keys(x, label), D.bucket_keys(y, label)
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() > 0.998
    other = D.bucket_keys(x, label + 1)
    assert not (a[:, :, None] == other[:, None, :]).any()


def test_rotation_keeps_lengths_and_angles():
    x = vectors(np.random.default_rng(4), 50)
    y = D.rotate(x, 3)
    assert np.allclose(x @ x.T, y @ y.T)
    h = D.hadamard(np.eye(8))
    assert np.array_equal(h @ h.T, 8 * np.eye(8)) and set(np.unique(h)) == {-1.0, 1.0}
