"""Block self-join: verify the pairs that share a bucket, count them once.

``link`` takes items with bucket keys and a test of payloads.  It never emits
pairs: a task gets the items of one bucket (or of two chunks of a large one),
tests them against each other and returns, per item, the weight of the items
it links with, and the smallest item it reaches inside the block.  A pair that
shares several buckets counts only in the first of them, which a block can
tell because every item carries the list of its buckets.

Buckets with the same members are one bucket, buckets of one item are dropped
before any payload moves, and a bucket is cut into chunks of about ``CHUNK``
items or ``CHUNK_BYTES`` of payload that meet pairwise, so a group with a third
of all items is many bounded tasks.  No bucket is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.session import materialize

CHUNK = 1024
CHUNK_BYTES = 16 << 20


def reach(adjacent: np.ndarray) -> np.ndarray:
    """The first node that each node of a graph reaches (nodes in order)."""
    n = len(adjacent)
    first = np.full(n, -1)
    for i in range(n):
        if first[i] >= 0:
            continue
        front = np.array([i])
        first[i] = i
        while len(front):
            near = adjacent[front].any(axis=0) & (first < 0)
            front = np.flatnonzero(near)
            first[front] = i
    return first


def shared_before(keys: list[np.ndarray], key: int) -> np.ndarray | None:
    """Which pairs share a bucket whose key is below ``key``; None: no pair."""
    each = [k[:np.searchsorted(k, key)] for k in keys]
    flat = np.concatenate(each)
    if not len(flat):
        return None
    values, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(keys)), [len(k) for k in each])
    out = np.zeros((len(keys), len(keys)), dtype=bool)
    wanted = np.flatnonzero(n > 1)
    place = np.full(len(values), -1)
    place[wanted] = np.arange(len(wanted))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    for at in range(0, len(wanted), 4096):
        part = (column >= at) & (column < at + 4096)
        m = np.zeros((len(keys), min(4096, len(wanted) - at)), dtype=np.float32)
        m[row[part], column[part] - at] = 1
        out |= (m @ m.T) > 0
    return out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole runs of (key, lo, hi) of a sorted stream of batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k, lo, hi = b["key"].to_numpy(), b["lo"].to_numpy(), b["hi"].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        bounds = [0, *cuts.tolist(), len(b)]
        for i, j in zip(bounds[:-1], bounds[1:]):
            run = b.iloc[i:j]
            if i == 0 and held:
                last = held[-1]
                if (last["key"].iat[0], last["lo"].iat[0], last["hi"].iat[0]) == (k[0], lo[0], hi[0]):
                    held.append(run)
                    continue
            if held:
                yield held[0] if len(held) == 1 else pd.concat(held)
            held = [run]
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def block_task(accept: Callable[[list[bytes]], np.ndarray]):
    """The mapInPandas function: ``accept`` gives the symmetric matrix of the
    payloads that link."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, links, lows, held = [], [], [], 0
        for b in _blocks(batches):
            if len(b) < 2:
                continue
            id_, weight = b["id"].to_numpy(), b["weight"].to_numpy()
            key, lo, hi = b["key"].iat[0], b["lo"].iat[0], b["hi"].iat[0]
            ok = accept(b["payload"].tolist())
            np.fill_diagonal(ok, False)
            if lo != hi:
                chunk = b["chunk"].to_numpy()
                ok &= chunk[:, None] != chunk[None, :]
            if not ok.any():
                continue
            before = shared_before(b["keys"].tolist(), key)
            if before is not None:
                ok &= ~before
            linked = np.flatnonzero(ok.any(axis=0))
            if not len(linked):
                continue
            ok, id_ = ok[np.ix_(linked, linked)], id_[linked]
            ids.append(id_)
            links.append(ok @ weight[linked])
            lows.append(id_[reach(ok)])
            held += len(id_)
            if held > 100_000:
                yield pd.DataFrame({"id": np.concatenate(ids), "n": np.concatenate(links), "low": np.concatenate(lows)})
                ids, links, lows, held = [], [], [], 0
        if ids:
            yield pd.DataFrame({"id": np.concatenate(ids), "n": np.concatenate(links), "low": np.concatenate(lows)})
    return run


def link(items: DataFrame, payloads: Callable[[DataFrame], DataFrame],
         accept: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """Link items.  ``items``: a written table id (unique long), weight (long),
    bytes (of the payload, about) and keys (array of longs).  ``payloads``
    gets the items that share a bucket with another (id, buckets) and returns
    id, weight, buckets and payload, each item once.  Returns id, n (weight of the items linked), low (an item of the
    same component): a row for every block that holds a link of the item."""
    members = items.select("id", "bytes", F.explode(F.array_distinct("keys")).alias("key"))
    buckets = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    kept = materialize(
        buckets.where("n > 1").groupBy("n", "bytes", "x", "y").agg(F.min("key").alias("key"))
        .select("key", F.greatest(F.ceil(F.col("n") / F.lit(CHUNK)),
                                  F.ceil(F.col("bytes") / F.lit(CHUNK_BYTES))).cast("int").alias("chunks")),
        "buckets")
    own = materialize(
        members.select("id", "key").join(kept, "key").groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("key", "chunks"))).alias("buckets")), "members")
    rows = (payloads(own)
            .select("id", "weight", "payload", F.col("buckets.key").alias("keys"), F.inline("buckets"))
            .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"),
                    "chunk", "id", "weight", "keys", "payload"))
    return (rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")
            .mapInPandas(block_task(accept), "id long, n long, low long"))
