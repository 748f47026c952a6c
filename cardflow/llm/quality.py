"""Quality classifier: supervised subword embeddings.

A document's features are its words, the n-grams of 3 to 5 bytes inside its
words (a word's edges marked by the white space around it) and, of its word
pairs, those that repeat a word; they are hashed into ``BUCKETS``, with one
more bucket for the repeats.  Every bucket has a learned vector of ``DIM`` numbers; a document
is the average of its features' vectors, and a softmax layer on top gives the
probability of label 1.  Both are trained together by stochastic gradient
descent in numpy.

Training reads at most ``TRAIN_ROWS`` labelled documents, chosen by a hash of
their ids (the documented bound of the sample); their features are counted in
tasks and only bucket counts reach the driver.  Every other step covers all
rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.hashing import SPACE, WordHasher, buffers, encode

BUCKETS = 1 << 13
DIM = 16
NGRAMS = (3, 4, 5)
TRAIN_ROWS = 3000
EPOCHS = 8
RATE = 40.0
BATCH = 32
SEED = 11
THRESHOLD = 0.3
HELD_OUT_MOD = 5


def feature_counts(texts, hasher: WordHasher, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Counts of hashed features, [texts, buckets + 1], a few texts at a
    time: the number of the first text and the counts."""
    shift = np.uint64(64 - (buckets - 1).bit_length())
    raw = encode(texts)
    at = 0
    while at < len(raw):  # texts of about a megabyte in all, or one longer text
        stop, size = at, 0
        while stop < len(raw) and stop - at < 128 and (stop == at or size + len(raw[stop]) <= 1 << 20):
            size += len(raw[stop])
            stop += 1
        width = buckets + 1
        out = np.zeros((stop - at) * width, dtype=np.int64)
        for buf, text, length in buffers(raw[at:stop]):
            ends = 1 + np.cumsum(length)
            base = text * width
            h, start, _ = hasher.spans(buf)
            of = base[np.searchsorted(ends, start, side="right")]
            again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
            found = [of + (h >> shift).astype(np.int64), of[1:][again] + buckets]
            owner = np.repeat(base, length)  # of every byte but the first
            plain = np.where(SPACE[buf], np.uint8(32), buf).astype(np.uint32)
            spaces = np.cumsum(SPACE[buf], dtype=np.int32)
            for n in NGRAMS:
                if len(buf) < n:
                    continue
                g = plain[:len(buf) - n + 1] * np.uint32(0x01000193) + np.uint32(n)
                for j in range(1, n):
                    g = (g ^ plain[j:len(buf) - n + 1 + j]) * np.uint32(0x01000193)
                g *= np.uint32(0x9E3779B1)
                inside = spaces[n - 2:len(buf) - 1] == spaces[:len(buf) - n + 1]
                inside &= ~SPACE[buf[1:len(buf) - n + 2]]
                pos = np.flatnonzero(inside)
                # the n-gram's second byte is not white space and names its text
                found.append(owner[pos] + (g[pos] >> np.uint32(32 - (buckets - 1).bit_length())).astype(np.int64))
            out += np.bincount(np.concatenate(found), minlength=len(out))
        yield at, out.reshape(stop - at, width).astype(np.float32)
        at = stop


@dataclass(frozen=True)
class Model:
    """Bucket vectors [buckets + 1, dim], softmax weights [dim, 2] and bias [2]."""
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of feature counts."""
        mean = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        z = mean @ self.vectors @ self.weights + self.bias
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int = BUCKETS, dim: int = DIM,
        epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Train on (label, buckets, counts).  No rows, or none with features:
    only the bias is learned; no rows at all: every score is 0.5."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets + 1, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, 2)), np.zeros(2)
    steps, done = max(1, epochs * -(-len(rows) // BATCH)), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            part = [rows[i] for i in order[at:at + BATCH]]
            x = np.zeros((len(part), buckets + 1), dtype=np.float32)
            for r, (_, b, c) in enumerate(part):
                if len(b):
                    x[r, b] = c / c.sum()
            y = np.eye(2)[[p[0] for p in part]]
            hidden = x @ vectors
            z = hidden @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - y) / len(part)
            lr = rate * (1 - done / steps)
            back = (error @ weights.T * lr).astype(np.float32)
            weights -= lr * hidden.T @ error
            bias -= lr * error.sum(axis=0)
            vectors -= x.T @ back
            done += 1
    return Model(vectors, weights, bias)


def _count_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hasher = WordHasher()
    for b in batches:
        for first, counts in feature_counts(b["text"], hasher):
            hit = [np.flatnonzero(c) for c in counts]
            part = b.iloc[first:first + len(counts)]
            yield pd.DataFrame({"label": part["label"].to_numpy(), "doc_id": part["doc_id"].to_numpy(),
                                "tie": part["tie"].to_numpy(),
                                "buckets": [h.astype("<u2").tobytes() for h in hit],
                                "counts": [c[h].astype("<f4").tobytes() for c, h in zip(counts, hit)]})


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text is
    divisible by 5.  A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_MOD == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents that are not held out.  ``labels``: doc_id,
    quality; several labels of a document are averaged (0.5 counts as 1),
    null ones are passed over.  At most ``rows`` documents (texts that differ)
    are learned from; they alone reach the driver, as feature counts."""
    known = (labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
             .join(docs.select("doc_id"), "doc_id", "left_semi")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    # the ids are bounded, their rows need not be: of these at most ``rows`` are taken, by a hash
    tie = F.xxhash64("text").alias("tie")
    theirs = docs.select("doc_id", tie, "text").join(F.broadcast(known), "doc_id")
    few = (theirs.select("doc_id", "tie").distinct()
           .orderBy(F.xxhash64("doc_id"), F.xxhash64("doc_id", "tie"), "doc_id", "tie").limit(rows))
    picked = theirs.join(F.broadcast(few), ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"])
    got = picked.select("label", "doc_id", "tie", "text").mapInPandas(
        _count_rows, "label int, doc_id long, tie long, buckets binary, counts binary").toPandas()
    # tasks end in any order; a fixed order makes reruns agree
    got = got.sort_values(["doc_id", "tie"])
    return fit([(int(y), np.frombuffer(b, "<u2"), np.frombuffer(c, "<f4"))
                for y, b, c in zip(got["label"], got["buckets"], got["counts"])])


def scorer(model: Model):
    """A Column function: the probability that a text's label is 1.  Null and
    empty texts have no features and score by the bias."""
    parts = (model.vectors.astype(np.float32), model.weights, model.bias)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, own = WordHasher(), Model(*parts)
        for texts in batches:
            out = np.zeros(len(texts))
            for first, counts in feature_counts(texts, hasher):
                out[first:first + len(counts)] = own.score(counts)
            yield pd.Series(out)
    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of
    every row of ``docs`` (doc_id, text).  Repeated rows get equal scores; no
    labels: 0.5 for all; empty tables give empty results."""
    score = scorer(train(docs, labels))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).select(
        "*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns kept."""
    score = scorer(train(docs, labels))
    return docs.where(score("text") >= threshold).select(*docs.columns)
