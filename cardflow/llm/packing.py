"""Packing by lexical retrieval.

Documents become token ids (a public tokenizer, then an end id) in one pass,
which is written once together with the document frequencies of its ids.  The
corpus statistics of BM25, over all documents, are vocabulary-sized.  The
documents are then sorted, over the whole table, by their heaviest terms and
cut in that order into shards of bounded size; each shard gets an inverted index:
a window starts with a seed, the index returns the seed's unused neighbours,
best first by all distinct terms of the seed, and they fill the window; the
document that does not fit is cut and its rest is the next window's seed.  The
end id is a term of every document, of next to no weight, so documents that
share nothing else with the seed come last.  When a shard has no unused
document left, the next shard goes on in the open window.  So every window but
the last of a partition is full.

The ids are shuffled once, by the heaviest terms.  A seed asks its own shard
only; the README gives the measured share of its neighbours that lie there.  A text is tokenized by
its words (runs of bytes other than the ASCII white space, across which the
tokenizer never merges): the parts of all words of many texts are looked up at
once in a table of those its worker has seen (``wordtable``).  New plain
words are merged many at a time (``bpe``), all others by the library.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.llm.bpe import LONGEST, Merger
from cardflow.llm.common import default_partitions
from cardflow.llm.hashing import encode, kept_by_worker, mix, trim
from cardflow.llm.wordtable import SHORT, Parts, WordTable, byte_classes
from cardflow.session import materialize

WINDOW = 4096
END_ID = 2
SHARD_TOKENS = 1 << 21
SHARD_DOCS = 4096
ROUTE_TERMS = 3
BOUND_ROWS = 100
DENSE = 8  # a term of more than an eighth of the documents is held as a row
K1, B = 1.2, 0.75
CACHE_WORDS = 500_000
GROUP_BYTES = 1 << 22


class WordTokenizer:
    """Token ids of whole texts, by the parts of their words."""

    #: The tokenizer makes exactly two parts of letters whose lower case and
    #: composition are those of one character and such marks behind them.
    MARKS = b".,!?;:*&%$#()-"

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.merger = Merger(path)
        self.classes = byte_classes(self.MARKS)
        self.table = WordTable(self.kind)

    def _ids(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

    def _learn(self, parts: Parts, keys: np.ndarray, new: np.ndarray) -> None:
        """Put parts into the table: plain ones are merged, others asked of the library."""
        words = [parts[i] for i in new.tolist()]
        ids: list = [None] * len(words)
        merge = parts.plain[new] & (keys[3][new] <= LONGEST) if self.merger.usable else np.zeros(len(new), dtype=bool)
        for some, how in ((merge, self.merger.encode), (~merge, self._ids)):
            at = np.flatnonzero(some).tolist()
            if at:
                for i, x in zip(at, how([words[i] for i in at])):
                    ids[i] = x
        self.table.add(words, keys[:, new], ids)

    def _group(self, texts: list[bytes]) -> Iterator[bytes]:
        parts = Parts(texts, self.classes)
        keys = parts.numbers()
        if len(self.table) > CACHE_WORDS:
            self.table.clear()
        number = self.table.find(parts, keys, np.arange(len(parts.start)))
        while len(missing := np.flatnonzero(number < 0)):
            long = np.flatnonzero(keys[3][missing] > SHORT)
            short = np.delete(missing, long)
            unique: dict[bytes, int] = {parts[i]: i for i in missing[long].tolist()}
            scrambled = mix(keys[0, short] ^ mix(keys[1, short] ^ mix(keys[2, short] + keys[3, short])))
            first = np.unique(scrambled, return_index=True)[1]
            self._learn(parts, keys, np.concatenate((short[first], np.array(list(unique.values()), dtype=np.int64))))
            number[missing] = self.table.find(parts, keys, missing)
        ids, upto = self.table.ids(number)
        ends = np.concatenate(([0], upto))[parts.upto]
        at = 0
        for end in ends.tolist():
            yield ids[at:end].tobytes()
            at = end

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        group: list[bytes] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > GROUP_BYTES:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker: Spark uses a worker for many
    tasks, and what one has learned serves the next."""
    held = kept_by_worker()
    trim()
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order and their numbers; the stable sort of two
    bytes is by radix, which np.unique does not use."""
    ids = np.sort(ids, kind="stable")
    new = np.ones(len(ids) + 1, dtype=bool)
    if len(ids):
        np.not_equal(ids[1:], ids[:-1], out=new[1:-1])
    at = np.flatnonzero(new)
    return ids[at[:-1]], np.diff(at)


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = worker_tokenizer(path)
        end = np.array([end_id], dtype=t.kind).tobytes()
        df = np.zeros(t.vocabulary, dtype=np.int64)
        docs = 0
        for b in batches:
            raw = encode(b["text"])
            for at in range(0, len(raw), 2048):
                ids = [i + end for i in t.encode(raw[at:at + 2048])]
                n = np.array([len(i) // t.kind.itemsize for i in ids], dtype=np.int64)
                for i in ids:
                    df[distinct(np.frombuffer(i, t.kind))[0]] += 1
                docs += len(ids)
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[at:at + 2048].astype("Int64").array, "n": n,
                                    "ids": ids, "terms": None, "counts": None})
        if docs:
            used = np.flatnonzero(df)
            yield pd.DataFrame({"doc_id": pd.array([None], dtype="Int64"), "n": [docs], "ids": [None],
                                "terms": [used.astype(np.int32)], "counts": [df[used]]})
    return run


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """A written table: doc_id, n and ids (little-endian, two bytes an id for
    vocabularies of up to 65,536) of every document, and a row per task with
    its document count in n and its document frequencies (terms, counts)."""
    return materialize(docs.select("doc_id", "text").mapInPandas(
        _tokenize(path, end_id), "doc_id long, n long, ids binary, terms array<int>, counts array<long>"), "tokens")


def statistics(tokens: DataFrame) -> tuple[np.ndarray, float]:
    """BM25's term weights over all documents (one number an id, so bounded
    by the vocabulary), and the average length."""
    rows = tokens.where("ids is null")
    df = (rows.select(F.explode(F.arrays_zip("terms", "counts")).alias("z"))
          .groupBy(F.col("z.terms").alias("term")).agg(F.sum("z.counts").alias("df")).toPandas())
    docs = rows.agg(F.sum("n")).first()[0] or 0
    total = tokens.where("ids is not null").agg(F.sum("n")).first()[0] or 0
    idf = np.zeros(int(df["term"].max()) + 1 if len(df) else 1, dtype=np.float32)
    if len(df):
        idf[df["term"].to_numpy()] = np.log1p((docs - df["df"].to_numpy() + 0.5) / (df["df"].to_numpy() + 0.5))
    return idf, total / docs if docs else 1.0


class Index:
    """An inverted index with BM25 weights over a shard."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, average: float):
        width = len(idf)
        length = np.array([len(i) for i in ids])
        flat = np.concatenate(ids).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), length)
        pair, tf = np.unique(flat, return_counts=True)
        term, doc = pair // len(ids), pair % len(ids)
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))).astype(np.float32)
        self._hold(np.arange(len(ids)), term, doc, weight, width)

    def _hold(self, docs: np.ndarray, term: np.ndarray, doc: np.ndarray, weight: np.ndarray, width: int) -> None:
        """Keep the postings of ``docs`` (the numbers the documents had at
        first), sorted by term; the terms of many documents also as rows."""
        self.docs, self.term, self.doc, self.weight = docs, term, doc, weight
        self.start = np.searchsorted(term, np.arange(width + 1))
        n = np.diff(self.start)
        often = np.flatnonzero(n * DENSE > len(docs))
        self.row = np.full(width, -1)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), len(docs)), dtype=np.float32)
        held = self.row[term]
        self.rows[held[held >= 0], doc[held >= 0]] = weight[held >= 0]

    def keep(self, wanted: np.ndarray) -> None:
        """Forget the documents that ``wanted`` (a flag for each document held) does not name."""
        place = np.cumsum(wanted) - 1
        at = np.flatnonzero(wanted[self.doc])
        self._hold(self.docs[wanted], self.term[at], place[self.doc[at]], self.weight[at], len(self.row))

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """BM25 scores of all documents held, for all distinct terms of the seed."""
        term = distinct(ids)[0]
        row = self.row[term]
        out = self.rows[row[row >= 0]].sum(axis=0, dtype=np.float32)
        spans = [slice(i, j) for i, j in zip(self.start[term[row < 0]], self.start[term[row < 0] + 1]) if i < j]
        if spans:
            out += np.bincount(np.concatenate([self.doc[s] for s in spans]),
                               weights=np.concatenate([self.weight[s] for s in spans]), minlength=len(out))
        return out


class Packer:
    """Fills windows one after another; a window may span shards."""

    def __init__(self, window: int, idf: np.ndarray, average: float, first_sequence: int):
        self.window, self.idf, self.average = window, idf, average
        self.sequence, self.offset = first_sequence, 0
        self.out: list[tuple] = []

    def _place(self, doc_id, ids: np.ndarray) -> None:
        """Put a document behind what the window holds, cut at its end."""
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.window - self.offset)
            self.out.append((doc_id, at, n, len(ids), self.sequence, self.offset, ids[at:at + n].astype("<u4").tobytes()))
            at += n
            self.offset += n
            if self.offset == self.window:
                self.sequence, self.offset = self.sequence + 1, 0

    def shard(self, doc_ids: list, ids: list[np.ndarray]) -> pd.DataFrame:
        index = Index(ids, self.idf, self.average)
        unused = np.ones(len(ids), dtype=bool)
        following = 0
        while True:
            while following < len(ids) and not unused[following]:
                following += 1
            if following == len(ids):
                break
            seed, sequence = following, None
            while seed is not None:  # a cut document seeds the next window
                if unused[seed]:
                    unused[seed] = False
                    self._place(doc_ids[seed], ids[seed])
                if not self.offset:
                    break
                left = unused[index.docs]
                if 4 * np.count_nonzero(left) < 3 * len(left):
                    index.keep(left)
                    left = unused[index.docs]
                sequence, score = self.sequence, np.zeros(len(ids), dtype=np.float32)
                score[index.docs] = index.scores(ids[seed]) * left
                near = np.flatnonzero(score)
                if len(near) > 64:  # the best few are nearly always enough
                    best = near[np.argpartition(-score[near], 64)[:64]]
                    rest = None
                else:
                    best, rest = near, ()
                seed = None
                while best is not None and seed is None:
                    for d in best[np.argsort(-score[best], kind="stable")]:
                        unused[d] = False
                        self._place(doc_ids[d], ids[d])
                        if self.sequence != sequence:
                            seed = d
                            break
                    if seed is None:
                        best = near[unused[near]] if rest is None else None
                        rest = ()
        out, self.out = self.out, []
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])


def heaviest(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The ``ROUTE_TERMS`` terms of most weight (number times idf) of a
    document, heaviest first; -1 where it has fewer."""
    term, tf = distinct(ids)
    weight = idf[term] * tf
    best = np.argsort(-weight, kind="stable")[:ROUTE_TERMS]
    out = np.full(ROUTE_TERMS, -1, dtype=np.int64)
    out[:len(best)] = term[best]
    return out


def _keys(batch: pd.DataFrame, idf: np.ndarray, itemsize: int) -> np.ndarray:
    return np.array([heaviest(np.frombuffer(raw, f"<u{itemsize}"), idf) for raw in batch["ids"]],
                    dtype=np.int64).reshape(-1, ROUTE_TERMS)


def _key_rows(idf: np.ndarray, itemsize: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = _keys(b, idf, itemsize)
            yield pd.DataFrame({f"t{j}": keys[:, j] for j in range(ROUTE_TERMS)} | {"tie": b["tie"]})
    return run


def _route(idf: np.ndarray, itemsize: int, bounds: list[tuple]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = _keys(b, idf, itemsize)
            part = [bisect_right(bounds, (*k, t)) for k, t in zip(keys.tolist(), b["tie"].tolist())]
            yield b.assign(doc_id=b["doc_id"].astype("Int64"), part=np.array(part, dtype=np.int32),
                           **{f"t{j}": keys[:, j] for j in range(ROUTE_TERMS)})
    return run


def routed(tokens: DataFrame, idf: np.ndarray, itemsize: int) -> DataFrame:
    """The documents of the token table in the order of their heaviest terms,
    in ranges: documents about the same things lie together, wherever the
    table has them, and the documents of a hot term are split by the next
    one, at last by a hash of the row.  The ranges' bounds come from a sample
    of about ``BOUND_ROWS`` documents a range; they set how even the ranges
    are, and every document lies in one."""
    rows = tokens.where("ids is not null").select(
        "doc_id", "n", "ids", F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("tie"))
    by = [f"t{j}" for j in range(ROUTE_TERMS)] + ["tie"]
    kinds = ", ".join(f"{t} long" for t in by)
    docs, ids = tokens.where("terms is null").agg(F.count(F.lit(1)), F.sum("n")).first()  # two numbers
    # a range ends with a window that may not be full: no more ranges than whole shards
    ranges = max(1, min(default_partitions(tokens.sparkSession), (ids or 0) // SHARD_TOKENS))
    share = BOUND_ROWS * ranges / docs if docs else 1.0
    some = rows if share >= 1 else rows.sample(share, seed=1)
    keys = sorted(tuple(r) for r in some.mapInPandas(_key_rows(idf, itemsize), kinds).collect())
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    placed = rows.mapInPandas(_route(idf, itemsize, bounds), f"doc_id long, n long, ids binary, tie long, part int, "
                              + ", ".join(f"{t} long" for t in by[:-1]))
    return placed.repartitionById(ranges, "part").sortWithinPartitions(*by).select("doc_id", "n", "ids")


def _pack(window: int, idf: np.ndarray, average: float, itemsize: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept_by_worker().clear()
        trim()
        packer = Packer(window, idf, average, TaskContext.get().partitionId() << 40)
        doc_ids: list = []
        ids: list[np.ndarray] = []
        size = 0
        for b in batches:
            for doc_id, n, raw in zip(b["doc_id"].astype("Int64"), b["n"], b["ids"]):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(raw, f"<u{itemsize}"))
                size += n
                if size >= SHARD_TOKENS or len(ids) >= SHARD_DOCS:
                    yield packer.shard(doc_ids, ids).astype({"doc_id": "Int64"})
                    doc_ids, ids, size = [], [], 0
        if ids:
            yield packer.shard(doc_ids, ids).astype({"doc_id": "Int64"})
    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most
    ``window`` ids; ``path``: the tokenizer's file.

    Returns a row per piece: doc_id, start (its document's ids before it),
    length, doc_tokens (with the end id), sequence_id, offset and ids
    (little-endian, four bytes an id).  A null or empty text is the end id
    alone; repeated rows are documents of their own; long texts fill windows
    of their own; an empty table gives an empty result.
    """
    from tokenizers import Tokenizer
    itemsize = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    tokens = tokenize(docs, path, end_id)
    idf, average = statistics(tokens)
    return routed(tokens, idf, itemsize).mapInPandas(
        _pack(window, idf, average, itemsize),
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack_report(docs: DataFrame, path: str, **how) -> DataFrame:
    """The pieces of ``pack`` with the CRC-32 of their ids in place of them."""
    return pack(docs, path, **how).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                                          "doc_tokens", "sequence_id", "offset")
