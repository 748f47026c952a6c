"""N-gram Jaccard self-join by MinHash banding.

A document's words are its runs of characters other than the ASCII white
space, as they stand; its n-grams are the sets of ``N`` consecutive words (all
its words, if it has fewer).  MinHash values are taken over the n-grams and
cut into bands of ``ROWS`` values; the number of bands is the least that finds
a pair at the threshold with probability ``RECALL``.  Documents are shuffled on
their band hashes, and pairs that share a band are verified on their full
n-gram sets, which are rebuilt from the text for those documents only.

Documents with the same words in the same order form a class, which is hashed
and compared once.  See ``pairs.link`` for how large groups are split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.common import components, with_row_id
from cardflow.llm.hashing import WordHasher, encode, mix, powers
from cardflow.llm.pairs import link
from cardflow.session import materialize

N = 5
THRESHOLD = 0.8
ROWS = 5
RECALL = 0.9999
SEED = 7_919
BATCH = 1 << 17  # n-grams hashed together: fits a core's cache


def bands(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands of ``rows`` values that finds a pair at
    ``threshold`` with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def grams(h: np.ndarray, counts: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hashes of texts whose word hashes lie one after another, and
    the number of n-grams of each text (repeats included)."""
    factors = powers(0xD6E8FEB86659FD93, n + 1)[1:]
    first = np.concatenate(([0], np.cumsum(counts)))
    whole = np.maximum(counts - n + 1, 0)
    total = np.where(counts >= n, whole, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(total)))
    out = np.empty(at[-1], dtype=np.uint64)
    if len(h) >= n:
        sums = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for j in range(n):
            sums += h[j:len(h) - n + 1 + j] * factors[j]
        place = np.flatnonzero(counts >= n)
        take = np.repeat(first[place] - np.concatenate(([0], np.cumsum(whole[place])))[:-1], whole[place]) + np.arange(whole.sum())
        out[np.repeat(at[place] - np.concatenate(([0], np.cumsum(whole[place])))[:-1], whole[place]) + np.arange(whole.sum())] = sums[take]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        w = h[first[i]:first[i + 1]]
        with np.errstate(over="ignore"):
            out[at[i]] = (w * factors[:len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))
    return mix(out), total


def signatures(g: np.ndarray, counts: np.ndarray, values: int) -> np.ndarray:
    """MinHash values, [texts with n-grams, values], of n-gram hashes that lie
    one text after another."""
    rng = np.random.default_rng(SEED)
    xor = rng.integers(0, 2**32, size=values, dtype=np.uint32)
    mul = rng.integers(0, 2**31, size=values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    g = (g >> np.uint64(32)).astype(np.uint32)
    counts = counts[counts > 0]
    ends = np.cumsum(counts)
    sig = np.full((len(counts), values), 0xFFFFFFFF, dtype=np.uint32)
    # slices of texts; a long text lies in several slices
    at = 0
    while at < len(g):
        stop = min(at + BATCH, len(g))
        part = g[at:stop]
        i, j = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, stop - 1, side="right") + 1
        starts = np.maximum(np.concatenate(([0], ends))[i:j] - at, 0)
        work = np.empty_like(part)
        for v in range(values):
            np.bitwise_xor(part, xor[v], out=work)
            np.multiply(work, mul[v], out=work)
            sig[i:j, v] = np.minimum(sig[i:j, v], np.minimum.reduceat(work, starts))
        at = stop
    return sig


def order_keys(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence; empty texts: 0."""
    keep = counts[counts > 0]
    starts = np.concatenate(([0], np.cumsum(keep)))[:-1]
    place = (np.arange(len(h)) - np.repeat(starts, keep)).astype(np.uint64)
    out = []
    for seed in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F):
        k = np.zeros(len(counts), dtype=np.uint64)
        if len(h):
            k[counts > 0] = mix(np.add.reduceat(mix(h ^ mix(place * np.uint64(seed) + np.uint64(1))), starts))
        out.append(k.view(np.int64))
    return out[0], out[1]


def _sign(threshold: float, n: int, rows: int, recall: float):
    count = bands(threshold, rows, recall)
    salts = powers(0xA0761D6478BD642F, rows + 1)[1:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for b in batches:
            h, words = hasher.words(encode(b["text"]))
            k1, k2 = order_keys(h, words)
            g, total = grams(h, words, n)
            sig = signatures(g, total, count * rows).astype(np.uint64).reshape(-1, count, rows)
            band = mix((sig * salts).sum(axis=2, dtype=np.uint64) + np.arange(count, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))
            keys: list = [None] * len(b)
            for i, row in zip(np.flatnonzero(total > 0), band.view(np.int64)):
                keys[i] = row
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "tie": b["tie"], "k1": k1, "k2": k2,
                                "words": words, "keys": keys})
    return run


def _sets(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for b in batches:
            h, words = hasher.words(encode(b["text"]))
            k1, k2 = order_keys(h, words)
            g, total = grams(h, words, n)
            ends = np.cumsum(total)
            yield pd.DataFrame({"k1": k1, "k2": k2, "payload": [
                np.unique(g[e - t:e]).tobytes() for e, t in zip(ends, total)]})
    return run


def accept_jaccard(threshold: float):
    """Pairs of sets (sorted 64-bit hashes) whose Jaccard similarity is at
    least ``threshold``, compared exactly."""
    t = Fraction(str(threshold))
    up, down = t.numerator, t.denominator

    def accept(payloads: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(p, "<u8") for p in payloads]
        size = np.array([len(s) for s in sets], dtype=np.int64)
        if len(sets) == 2:
            both = np.zeros((2, 2), dtype=np.int64)
            both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        else:
            flat = np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            new = np.concatenate(([True], flat[order][1:] != flat[order][:-1]))
            column = np.empty(len(flat), dtype=np.int64)
            column[order] = np.cumsum(new) - 1
            often = np.bincount(column) > 1
            place = np.cumsum(often) - 1
            row = np.repeat(np.arange(len(sets)), size)
            keep = often[column]
            row, column = row[keep], place[column[keep]]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            both = np.zeros((len(sets), len(sets)), dtype=np.int64)
            width = 4096
            for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
                i, j = np.searchsorted(column, [at, at + width])
                m = np.zeros((len(sets), width), dtype=np.float32)
                m[row[i:j], column[i:j] - at] = 1
                both += (m @ m.T).astype(np.int64)
        union = size[:, None] + size[None, :] - both
        return (both > 0) & (both * down >= union * up)
    return accept


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, rows: int = ROWS,
                 recall: float = RECALL) -> DataFrame:
    """Link the rows of ``docs`` (doc_id, text) whose n-gram sets have a
    Jaccard similarity of at least ``threshold``.

    Returns a row per row: doc_id, class_id (smallest doc_id with the same
    words in the same order), n_links (other rows linked directly),
    component_id (smallest doc_id reachable by links, its own included) and
    kept (it is that doc_id).  Null and empty texts have no n-grams and link
    with nothing: each is its own class.  Repeated rows are rows of their own
    and link with each other.  A null doc_id links like any other but names a
    class or component only where all its ids are null.  Empty tables give
    empty results.
    """
    return _join(docs, threshold, n, rows, recall).drop("tie", "part")


def text_key() -> Column:
    """A 64-bit hash of a row's text: with the doc_id it tells rows apart."""
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def _join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, rows: int = ROWS,
          recall: float = RECALL) -> DataFrame:
    """The rows of ``jaccard_join`` with their ``text_key`` as ``tie`` and a
    number of their component as ``part`` (null for rows without n-grams)."""
    docs = docs.select("doc_id", "text")
    signed = materialize(docs.withColumn("tie", text_key()).mapInPandas(
        _sign(threshold, n, rows, recall),
        "doc_id long, tie long, k1 long, k2 long, words long, keys array<long>"), "signatures")
    classes = (signed.where("keys is not null").groupBy("k1", "k2")
               .agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("class_id")))
    keyed = with_row_id(classes, "id")
    # a class's bands stand on every row of it; they are taken from the rows of its first document
    items = materialize(
        signed.where("keys is not null").select("doc_id", "k1", "k2", "words", "keys")
        .join(keyed, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
        .groupBy("id", "weight", "k1", "k2", "class_id")
        .agg(F.max(F.col("words") * 8).alias("bytes"), F.first("keys").alias("keys")), "items")

    def payloads(own: DataFrame) -> DataFrame:
        wanted = items.select("id", "weight", "k1", "k2", "class_id").join(own, "id")
        firsts = wanted.select("class_id").distinct()
        # a merge join at every size: what the texts cost here grows evenly
        sets = (docs.hint("merge").join(firsts, F.col("doc_id").eqNullSafe(F.col("class_id"))).select("text")
                .mapInPandas(_sets(n), "k1 long, k2 long, payload binary"))
        return (sets.groupBy("k1", "k2").agg(F.first("payload").alias("payload"))
                .join(wanted, ["k1", "k2"]).select("id", "weight", "buckets", "payload"))

    found = materialize(link(items, payloads, accept_jaccard(threshold)), "links")
    parts = components(found.where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v")))
    named = parts.join(keyed.select("id", "class_id"), "id")
    lowest = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
    linked = (keyed.join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left")
              .join(named.select("id", "component").join(lowest, "component"), "id", "left")
              .select("k1", "k2", "class_id", F.coalesce("component", "id").alias("part"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"),
                      F.coalesce("component_id", "class_id").alias("component_id")))
    linked = materialize(linked, "classes")
    out = (signed.select("doc_id", "tie", F.when(F.col("keys").isNotNull(), F.col("k1")).alias("k1"), "k2")
           .join(linked, ["k1", "k2"], "left"))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "tie", "part", F.coalesce("class_id", "doc_id").alias("class_id"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row of each group of near copies stays, whole: that with the
    smallest doc_id (a null one comes last).  Rows are judged by their texts
    alone: rows that share a doc_id but not a text, and rows without texts or
    links, all stay.  Within a doc_id texts are told apart by 64 bits."""
    tie = "__tie"
    verdict = materialize(_join(docs, **how).where("n_links > 0").groupBy("part", "doc_id", "tie")
                          .agg(F.count(F.lit(1)).alias("rows")), "verdict")
    first = verdict.groupBy("part").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("f"))
    # met again by row and not by group: a group may hold a third of all rows
    won = first.select(F.col("f.doc_id").alias("its"), F.col("f.tie").alias("its_tie"))
    judged = materialize(verdict.join(won, F.col("doc_id").eqNullSafe(F.col("its")) & (F.col("tie") == F.col("its_tie")), "left")
                         .select(F.col("doc_id").alias("__id"), F.col("tie").alias("__key"), "rows",
                                 F.col("its_tie").isNotNull().alias("first")), "judged")
    rows = docs.withColumn(tie, text_key())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col(tie) == F.col("__key"))
    # what goes, and the first ones that stand there several times, of which one comes back
    out = judged.where("NOT first OR rows > 1").select("__id", "__key")
    again = judged.where("first AND rows > 1").select("__id", "__key")
    rest = rows.hint("merge").join(out, same, "left_anti")
    return rest.unionByName(rows.join(again, same, "left_semi").dropDuplicates(["doc_id", tie])).select(*docs.columns)
