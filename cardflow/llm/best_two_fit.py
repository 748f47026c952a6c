"""Packing by best-two-fit.

A sequence is filled greedily: the longest unpacked document, then again and
again the longest that still fits.  When nothing fits any more, its smallest
document goes back if two unpacked documents together fill its place and the
gap more tightly; of all such pairs the one that leaves the least gap is taken.

Which documents of a length are taken makes no difference to a packing, so the
sequences are planned on the number of pieces of each length: at most
``window`` numbers, whatever the corpus holds.  The plan says "so many
sequences of these lengths" and has at most about ``window`` * ln(``window``)
such lines, since each uses up a length or leaves fewer of it than a line
takes.  Spark counts the lengths, numbers the pieces of each length within
slices (what one task cut) and over slices, and every piece finds its sequence
from its number; no sequence, document or id passes the driver, and a length
that a third of all pieces share is spread over the slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardflow.llm.packing import worker_tokenizer
from cardflow.session import materialize

WINDOW = 2048
END_ID = 0


class Stock:
    """The numbers of unpacked pieces by length."""

    def __init__(self, counts: np.ndarray):
        self.count = counts.astype(np.int64)
        self.held = np.flatnonzero(self.count)

    def longest(self, room: int) -> int:
        """The greatest length held of at most ``room``; 0 if there is none."""
        at = np.searchsorted(self.held, room, side="right")
        return int(self.held[at - 1]) if at else 0

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if not self.count[length]:
            self.held = np.delete(self.held, np.searchsorted(self.held, length))

    def give(self, length: int, n: int) -> None:
        if not self.count[length]:
            self.held = np.insert(self.held, np.searchsorted(self.held, length), length)
        self.count[length] += n

    def best_pair(self, room: int) -> tuple[int, int]:
        """Two lengths held whose sum is the greatest of at most ``room``
        (of several the pair with the longer piece); (0, 0) if there is none."""
        first = self.held[:np.searchsorted(self.held, room)]
        if not len(first):
            return 0, 0
        at = np.searchsorted(self.held, np.minimum(room - first, first), side="right") - 1
        second = np.where(at >= 0, self.held[at], 0)
        alone = (second == first) & (self.count[first] < 2)
        second[alone] = np.where(at[alone] > 0, self.held[at[alone] - 1], 0)
        total = np.where(second > 0, first + second, 0)
        best = len(total) - 1 - int(np.argmax(total[::-1]))
        return (int(first[best]), int(second[best])) if total[best] else (0, 0)


def plan(counts: np.ndarray, window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-two-fit over ``counts`` (index: length, 0 to ``window``): lines
    (number of sequences, [(length, pieces of it in each)], longest first).

    Sequences filled one at a time would repeat a line until one of its
    lengths is used up, as every choice depends only on which lengths are
    left; so a line stands for all of them."""
    stock, out = Stock(counts), []
    while len(stock.held):
        used: dict[int, int] = {}
        room = window
        while length := stock.longest(room):
            n = min(room // length, int(stock.count[length]))
            used[length] = used.get(length, 0) + n
            stock.take(length, n)
            room -= n * length
        if room and sum(used.values()) > 1:
            smallest = min(used)
            a, b = stock.best_pair(room + smallest)
            if a + b > smallest:
                for length in (a, b):
                    stock.take(length, 1)
                    used[length] = used.get(length, 0) + 1
                used[smallest] -= 1
                stock.give(smallest, 1)
                if not used[smallest]:
                    del used[smallest]
        more = min(int(stock.count[length]) // n for length, n in used.items())
        if more:
            for length, n in used.items():
                stock.take(length, n * more)
        out.append((more + 1, sorted(used.items(), reverse=True)))
    return out


def _cut(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_tokenizer(path)
        end = np.array([end_id], dtype=t.kind).tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, dtype=np.int64)
        step = window * t.kind.itemsize
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                ids = [i + end for i in t.encode([x or b"" for x in b.column("text").to_pylist()])]
                pieces = np.array([-(-len(i) // step) for i in ids])
                cut = [i[j:j + step] for i in ids for j in range(0, len(i), step)]
                n = np.array([len(c) // t.kind.itemsize for c in cut])
                piece = np.arange(len(cut)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                order = np.argsort(n, kind="stable")
                group = np.diff(n[order], prepend=-1) != 0
                nth = np.empty(len(n), dtype=np.int64)
                nth[order] = np.arange(len(n)) - np.flatnonzero(group)[np.cumsum(group) - 1]
                nth += seen[n]
                seen += np.bincount(n, minlength=window + 1)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").take(pa.array(np.repeat(np.arange(len(ids)), pieces))),
                    pa.array(piece.astype(np.int32)), pa.array(piece * window), pa.array(n),
                    pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(nth),
                    pa.array([np.frombuffer(c, t.kind).astype("<u4").tobytes() for c in cut], pa.binary())],
                    ["doc_id", "piece", "start", "length", "slice", "nth", "ids"])
    return run


def cut(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text): doc_id, piece,
    start, length and ids (little-endian, four bytes an id), and the slice
    that cut it with the number the piece has there among those of its length."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _cut(path, window, end_id),
        "doc_id long, piece int, start long, length long, slice int, nth long, ids binary")


def _seat(lines: list[tuple[int, list[tuple[int, int]]]], window: int):
    """Sequence and offset of a piece from its length and its number among
    all pieces of that length."""
    taken = np.zeros(window + 1, dtype=np.int64)
    rows, sequence = [], 0
    for bins, content in lines:
        offset = 0
        for length, n in content:
            rows.append((length, taken[length], n, offset, sequence))
            taken[length] += bins * n
            offset += length * n
        sequence += bins
    before = np.concatenate(([0], np.cumsum(taken)))
    length, first, n, offset, sequence = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    first = before[length] + first
    order = np.argsort(first)
    first, n, offset, sequence = first[order], n[order], offset[order], sequence[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = b.column("length").to_numpy()
            number = before[of] + b.column("number").to_numpy()
            line = np.searchsorted(first, number, side="right") - 1
            nth = number - first[line]
            keep = [c for c in b.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(sequence[line] + nth // n[line]),
                 pa.array(offset[line] + nth % n[line] * of)], [*keep, "sequence_id", "offset"])
    return run


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Put pieces (as ``cut`` gives them, ids or not) into sequences: adds
    sequence_id (gapless from 0) and offset, drops slice and nth."""
    pieces = materialize(pieces, "pieces")
    sizes = materialize(pieces.groupBy("slice", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        counts[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("slice", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    keep = [c for c in pieces.columns if c not in ("slice", "nth")]
    numbered = pieces.join(starts, ["slice", "length"]).select(*keep, (F.col("from") + F.col("nth")).alias("number"))
    kinds = dict(pieces.dtypes)
    return numbered.mapInArrow(_seat(plan(counts, window), window), ", ".join(
        [f"{c} {kinds[c]}" for c in keep] + ["sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into as few sequences of at
    most ``window`` ids as best-two-fit finds; ``path``: the tokenizer's file.

    Returns a row per piece: doc_id, piece, start, length, ids, sequence_id
    and offset.  Only documents of more than ``window`` ids (with the end id)
    are cut.  A null or empty text is the end id alone; repeated rows are
    documents of their own; an empty table gives an empty result; other
    columns of ``docs`` are ignored.
    """
    return place(cut(docs, path, window, end_id), window)


def pack_report(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of ``pack`` with the CRC-32 of their ids in place of them,
    taken before the pieces move."""
    pieces = cut(docs, path, window, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(pieces, window).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
