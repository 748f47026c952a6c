"""Embedding near-duplicates by cross-polytope hashing.

A vector is padded to a power of two and turned by a fast pseudo-random
rotation (three rounds of random signs and a Hadamard transform).  Its hash
is the nearest vertex of the cross-polytope: the coordinate with the largest
magnitude and its sign.  A table joins ``HASHES`` such hashes; a vector enters
its own bucket and ``PROBES`` more of each of ``TABLES`` tables, those where the
least is lost by taking the next vertices.  Pairs that share a bucket are
verified by their cosine in double precision (``pairs.link``).

Equal vectors (of one label) are one item with a weight, so copies are not
compared with each other.  With the defaults a pair at cosine 0.93 of 64
dimensions is found with probability above 0.999 (measured in the tests),
closer pairs more surely.  More rows need finer buckets: raise ``hashes``, and
``tables`` for the same recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.llm.common import components, with_row_id
from cardflow.llm.hashing import mix
from cardflow.llm.pairs import link
from cardflow.session import materialize

THRESHOLD = 0.93
TABLES, HASHES, PROBES = 6, 3, 5
SEED = 20_260


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of the rows (a power of two long)."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation of the rows, decided by ``seed``."""
    signs = np.random.default_rng([SEED, seed, x.shape[1]]).choice([-1.0, 1.0], size=(3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s) / np.sqrt(x.shape[1])
    return x


def bucket_keys(x: np.ndarray, label: np.ndarray, tables: int = TABLES, hashes: int = HASHES,
                probes: int = PROBES) -> np.ndarray:
    """Bucket keys of unit vectors, [rows, tables * (1 + probes)]; equal
    labels and dimensions only share keys."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - d)))
    keys = np.empty((n, tables, 1 + probes), dtype=np.uint64)
    start = mix(label.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))
    rows = np.arange(n)
    ways = min(3, size)
    for t in range(tables):
        codes, loss = [], []
        for h in range(hashes):
            y = rotate(x, t * hashes + h)
            big = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :ways]
            val = y[rows[:, None], big]
            codes.append(2 * big + (val < 0))
            loss.append((np.abs(val[:, :1]) - np.abs(val)) ** 2)
        # every choice of a vertex for each hash, the cheapest first
        picks = np.stack(np.meshgrid(*[np.arange(ways)] * hashes, indexing="ij"), -1).reshape(-1, hashes)
        cost = sum(loss[h][:, picks[:, h]] for h in range(hashes))
        best = np.argsort(cost, axis=1, kind="stable")[:, :1 + probes]
        for p in range(1 + probes):
            chosen = picks[best[:, min(p, best.shape[1] - 1)]]
            k = start + np.uint64(t + 1)
            for h in range(hashes):
                k = mix(k ^ (codes[h][rows, chosen[:, h]].astype(np.uint64) + np.uint64(1 + 2 * size * h)))
            keys[:, t, p] = k
    return keys.reshape(n, -1)


def usable(vectors) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with
    nothing: null, empty, zero, or with a null or non-finite component."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        if v is None or not len(v):
            out.append(None)
            continue
        a = np.array([np.nan if c is None else c for c in v], dtype=np.float64) if getattr(
            v, "dtype", None) == object or isinstance(v, list) else np.asarray(v, dtype=np.float64)
        top = np.abs(a).max()
        if not np.isfinite(a).all() or top == 0:
            out.append(None)
            continue
        a = a / top
        out.append(a / np.sqrt(a @ a))
    return out


def _hash_rows(tables: int, hashes: int, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            unit = usable(b["embedding"])
            sizes = {len(u) for u in unit if u is not None}
            for d in sorted(sizes):
                at = np.array([i for i, u in enumerate(unit) if u is not None and len(u) == d])
                x = np.stack([unit[i] for i in at])
                label = b["label"].to_numpy()[at]
                keys = bucket_keys(x, label, tables, hashes, probes).view(np.int64)
                head = label.astype("<i8")
                yield pd.DataFrame({
                    "id": b["id"].to_numpy()[at], "weight": b["weight"].to_numpy()[at],
                    "bytes": 8 * (d + 1), "keys": list(keys),
                    "payload": [head[i:i + 1].tobytes() + x[i].astype("<f8").tobytes() for i in range(len(at))]})
    return run


def accept_cosine(threshold: float):
    def accept(payloads: list[bytes]) -> np.ndarray:
        size = np.array([len(p) for p in payloads])
        rows = [np.frombuffer(p, "<f8", offset=8) for p in payloads]
        label = np.array([int.from_bytes(p[:8], "little", signed=True) for p in payloads])
        x = np.zeros((len(rows), max(map(len, rows))))
        for i, r in enumerate(rows):
            x[i, :len(r)] = r
        ok = (x @ x.T) >= threshold
        return ok & (size[:, None] == size) & (label[:, None] == label)
    return accept


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES,
                    hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """Link the rows of ``vectors`` (vec_id, embedding, label) with equal
    labels and a cosine of at least ``threshold``.

    Returns a row per row: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable, its own included), kept (it is
    that vec_id).  Vectors that are null, empty or zero or hold null or
    non-finite components, and rows with a null label, link with nothing;
    vectors of different lengths do not link.  Repeated rows are rows of
    their own and link with each other.  Empty tables give empty results.
    """
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull()
    classes = with_row_id(rows.where(fit).groupBy("label", "embedding").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first")), "id")
    items = materialize(classes.mapInPandas(
        _hash_rows(tables, hashes, probes),
        "id long, weight long, bytes long, keys array<long>, payload binary"), "items")
    found = materialize(link(items.drop("payload"), lambda own: items.select("id", "weight", "payload").join(own, "id"),
                             accept_cosine(threshold)), "links")
    parts = components(found.where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v")))
    named = parts.join(classes.select("id", "first"), "id")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = (classes.join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left")
              .join(named.select("id", "component").join(lowest, "component").drop("component"), "id", "left")
              .join(items.select("id", F.lit(True).alias("usable")), "id", "left")
              .select("label", "embedding",
                      F.when(F.col("usable"), F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"),
                      F.when(F.col("usable"), F.coalesce("component_id", "first")).alias("c")))
    out = rows.join(linked, ["label", "embedding"], "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
