"""Periodic runs of words by a suffix automaton with link-cut access.

Words are appended to a suffix automaton one at a time.  Its suffix links are
a link-cut tree in which every node carries the position where its words last
ended; all nodes of a preferred path have the same.  Appending word i walks
from the new state to the root (``access``): the path segments that ended at an
earlier e are cut off, read and recoloured to i.  The deepest node of a
segment says how many words ending at i also end at e.  If that is at least
the distance d = i - e, the last d words are a square, and the words back to
where the agreement begins are a stretch of smallest period d; as i goes on,
stretches of the same beginning and period grow into runs.  A splay tree per
preferred path makes a word cost amortized O(log n) steps; a new state between
two others joins the path of the lower one.

A run of at least four periods and six words holds each of its three-word
sequences three times.  So only stretches of a text whose consecutive
three-word sequences occur three times within the stretch are given to the
automaton; this is a necessary condition (tested by hashes, whose collisions
can only add stretches), and every run comes from the automaton.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.llm.hashing import WordHasher, mix

PERIODS = 4  # of a run at least
WORDS = 6
GROUP_BYTES = 1 << 22
ROUNDS = 4


def runs_of(x: list) -> list[tuple[int, int, int]]:
    """Runs of at least ``PERIODS`` periods and ``WORDS`` words of a sequence
    of hashable words: (start, length, period) by start, then period."""
    step: list = [None, {}]  # transitions; state 1 is the root, 0 none
    link, size = [0, 0], [0, 0]
    # the link-cut tree over all states but the root: a splay tree per preferred path (left: nearer to the
    # root); ``up`` of a splay tree's top is the node its path hangs from, and only that top's ``seen`` counts
    left, right, up, seen = [0, 0], [0, 0], [0, 0], [0, 0]
    found: dict[tuple[int, int], int] = {}
    last = 1

    def splay(v: int) -> None:
        while True:
            p = up[v]
            if not p or (left[p] != v and right[p] != v):
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                top = up[g]
                if (left[g] == p) == (left[p] == v):  # turn p over g first, then v over p
                    if left[g] == p:
                        a, b = right[p], right[v]
                        left[g], right[p], left[p], right[v] = a, g, b, p
                    else:
                        a, b = left[p], left[v]
                        right[g], left[p], right[p], left[v] = a, g, b, p
                    up[g], up[p] = p, v
                    if a:
                        up[a] = g
                    if b:
                        up[b] = p
                else:
                    a, b = left[v], right[v]
                    if left[g] == p:
                        right[p], left[g], left[v], right[v] = a, b, p, g
                        if a:
                            up[a] = p
                        if b:
                            up[b] = g
                    else:
                        right[g], left[p], left[v], right[v] = a, b, g, p
                        if a:
                            up[a] = g
                        if b:
                            up[b] = p
                    up[p] = up[g] = v
                up[v] = top
                if top:
                    if left[top] == g:
                        left[top] = v
                        continue
                    if right[top] == g:
                        right[top] = v
                        continue
                seen[v] = seen[g]
            else:
                if left[p] == v:
                    b = right[v]
                    left[p], right[v] = b, p
                else:
                    b = left[v]
                    right[p], left[v] = b, p
                if b:
                    up[b] = p
                up[p], up[v] = v, g
                seen[v] = seen[p]
            return

    for i, c in enumerate(x):
        cur = len(size)
        step.append({})
        size.append(i + 1)
        left.append(0)
        right.append(0)
        p = last
        while p and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if not p:
            parent = 1
        else:
            parent = step[p][c]
            if size[parent] != size[p] + 1:
                lower, parent = parent, cur + 1
                step.append(step[lower].copy())
                size.append(size[p] + 1)
                while p and step[p].get(c) == lower:
                    step[p][c] = parent
                    p = link[p]
        link.append(parent)
        up.append(parent if parent > 1 else 0)
        seen.append(i)
        if parent > cur:  # the new state between ``lower`` and what it hung from
            link.append(link[lower])
            link[lower] = parent
            splay(lower)
            above = left[lower]
            left.append(above)
            right.append(0)
            up.append(lower)
            seen.append(0)
            if above:
                up[above] = parent
            left[lower] = parent
        last = below = cur
        v = up[cur]
        while v:
            splay(v)
            d, same = i - seen[v], size[v]
            if same >= (PERIODS - 1) * d and same + d >= WORDS:
                found[i - same - d + 1, d] = i + 1
            off = right[v]
            if off:
                seen[off] = seen[v]
            right[v] = below
            below, v = v, up[v]
        seen[below] = i
    return sorted((start, end - start, d) for (start, d), end in found.items())


def stretches(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (among all words) of the stretches that can hold runs;
    ``h``: hashes of the words of several texts, of ``counts`` words each.
    Three words are counted within their text at first, then within their
    stretch, as long as that takes any away (``ROUNDS`` times at most)."""
    if len(h) < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = h + mix(h[np.minimum(np.arange(len(h)) + 1, len(h) - 1)] * np.uint64(3))
    three = mixed[:-2] + mix(h[2:] * np.uint64(5))
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(owner[:-2] == owner[2:])
    group = owner[at]
    bits = max(10, int(np.log2(len(h))) + 1)
    for k in range(ROUNDS):
        key = mix(three[at] + mix(group))
        if k == 0:  # a table of buckets is a weaker condition, but needs no sort
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
            often = np.bincount(bucket, minlength=1 << bits)[bucket] >= PERIODS - 1
        else:
            _, which, times = np.unique(key, return_inverse=True, return_counts=True)
            often = times[which] >= PERIODS - 1
        at, group = at[often], group[often]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (group[1:] != group[:-1])
        group = np.cumsum(new) - 1
        enough = np.bincount(group, minlength=1)[group] >= WORDS - 2 if len(at) else often[:0]
        at, group = at[enough], group[enough]
        if k and enough.all() and often.all() or not len(at):
            break
    if not len(at):
        return at, at
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return at[first], at[np.append(first[1:], len(at)) - 1] + 3


def find(texts: list[bytes], hasher: WordHasher) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """For each text its words and its runs (start, length, period)."""
    h, counts = hasher.words(texts)
    begin, end = stretches(h, counts)
    first = np.cumsum(counts) - counts
    of = np.searchsorted(first + counts, begin, side="right")
    spans: dict[int, list[tuple[int, int]]] = {}
    for t, a, b in zip(of.tolist(), (begin - first[of]).tolist(), (end - first[of]).tolist()):
        spans.setdefault(t, []).append((a, b))
    for t, text in enumerate(texts):
        words, runs = text.split(), []
        for a, b in spans.get(t, ()):
            runs += [(a + s, n, p) for s, n, p in runs_of(words[a:b])]
        yield words, sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what runs repeat: each run keeps its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n, p in runs:
        edge[start + p] += 1
        edge[start + n] -= 1
    return [w for w, inside in zip(words, np.cumsum(edge[:-1]).tolist()) if not inside]


def _task(prepare: Callable | None, emit: Callable, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            ids, raw = b.column("doc_id").to_pylist(), b.column("text")
            at = 0
            while at < len(ids):
                texts, size, begin = [], 0, at
                while at < len(ids) and size <= GROUP_BYTES:
                    text = raw[at].as_py() or b""
                    texts.append(prepare(ids[at], text) if prepare else text)
                    size += len(text)
                    at += 1
                rows = [emit(i, words, runs) for i, (words, runs) in zip(ids[begin:at], find(texts, hasher))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _whole(doc_id, words, runs):
    return doc_id, [{"start": s, "length": n, "period": p} for s, n, p in runs], \
        b" ".join(collapse(words, runs)).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): doc_id, runs (array of start,
    length and period, by start, then period) and text, the words outside the
    runs and each run's first period, joined by one space.

    Words are maximal pieces without ASCII white space and compare as bytes.
    A run is a stretch of smallest period q, of at least 4 q and 6 words, that
    no neighbour extends.  A null or empty text has no words; rows are
    documents of their own, also with equal or null ids; an empty table gives
    an empty result; other columns are ignored.  A text is worked on alone, so
    its length alone bounds a task's memory.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("text", pa.string())])
    return _texts(docs).mapInArrow(
        _task(None, _whole, schema), "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string")


def loop(doc_id: int | None, text: bytes) -> bytes:
    """One text of ten, by the CRC-32 of its id, ends in a loop of its own
    words; others, and texts without an id, stay."""
    if doc_id is None:
        return text
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return text
    words, g = text.split(), h // 10
    n = len(words)
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])


def _digest(doc_id, words, runs):
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    start, n, p = best or (None, None, None)
    return (doc_id, len(runs), start, n, p, 1000 * n // p if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest())


def run_report(docs: DataFrame) -> DataFrame:
    """For every document, some of them looped (``loop``): the number of its
    runs, the one of the greatest exponent, and digests of all of them and of
    the text that ``remove_repeats`` would leave."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    schema = pa.schema([*((c, pa.int64()) for c in names), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    return _texts(docs).mapInArrow(_task(loop, _digest, schema),
                                   ", ".join(f"{c} long" for c in names) + ", runs_sha256 string, collapsed_sha256 string")
