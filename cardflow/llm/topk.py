"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are split into blocks; a block keeps, for every dimension, its rows
sorted by that component.  Queries come to a block in groups and read the
lists from both ends (a negative weight reads from the low end), a deeper
slice each round.  Rows seen for the first time are scored whole.  After each
round a query's bound is the score that a row at the current depth of every
list would have; a query stops when that bound cannot beat its k-th result (a
tie still can, by a smaller id, so it stops only below it).  The blocks'
results, k rows a query each, are ranked together.

Queries are a stated set that grows with the table; they meet the vectors in
a grid of (vector block, query group) tasks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardflow.session import materialize

BLOCK = 16_384
QUERIES = 4_096
GROUP = 64
FIRST_DEPTH = 16
SCALE = 256
LARGEST = 1.7976931348623157e308  # of the finite doubles


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as double, as a double: from
    2^53 up every double is an integer already."""
    def floor(x: Column) -> Column:
        y = F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(LARGEST)), F.lit(-LARGEST))
        return F.when(F.abs(y) < F.lit(2.0 ** 53), F.floor(y).cast("double")).otherwise(y)
    return F.transform(embedding, floor)


def fit(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not empty, and all components
    finite."""
    return F.coalesce(F.forall(embedding, lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(LARGEST), F.lit(False)))
                      & (F.size(embedding) > 0), F.lit(False))


def _exact(x: np.ndarray, q: np.ndarray):
    """A number type in which every partial sum of an inner product is exact."""
    bound = (np.abs(x).max(axis=0, initial=0).astype(np.float64) * np.abs(q).max(axis=0, initial=0).astype(np.float64)).sum()
    return np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64 if bound < 2**62 else object


def _as(x: np.ndarray, kind) -> np.ndarray:
    """Whole doubles in another number type; ``object``: Python's integers."""
    return np.frompyfunc(int, 1, 1)(x) if kind is object else x.astype(kind)


def _longs(x: np.ndarray) -> np.ndarray:
    """Scores as longs hold them: beyond the longs, the nearest one."""
    return np.clip(x, -2**63, 2**63 - 1) if x.dtype == object else x


class Lists:
    """The sorted lists of one block; rows must be in id order."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.value = np.take_along_axis(x, self.order, axis=0)

    def top(self, q: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The k best rows of each query, best first, and their scores;
        ``own``: the row that is the query itself, or -1."""
        n = len(self.x)
        kind = _exact(self.x, q)
        x, w = _as(self.x, kind), _as(q, kind)
        scores = np.zeros((n, len(q)), dtype=kind)
        seen = np.zeros(n, dtype=bool)
        out: list = [None] * len(q)
        left = np.arange(len(q))
        last, depth = 0, min(FIRST_DEPTH, n)
        while len(left):
            reached = np.unique(np.concatenate((self.order[last:depth].ravel(),
                                                self.order[n - depth:n - last].ravel())))
            new = reached[~seen[reached]]
            seen[new] = True
            # random access; rows reached through another query's list count too
            scores[np.ix_(new, left)] = _longs(x[new] @ w[left].T)
            rows = np.flatnonzero(seen)
            done = np.ones(len(left), dtype=bool)
            if len(rows) < n:
                high, low = _as(self.value[n - depth], kind), _as(self.value[depth - 1], kind)
                bound = _longs(np.where(w[left] > 0, w[left] * high, w[left] * low).sum(axis=1))
                done = self._kth(scores, rows, left, k, own) > bound if len(rows) > k else ~done
            for i in left[done]:
                out[i] = self._best(scores[:, i], rows, k, own[i])
            left = left[~done]
            last, depth = depth, min(n, depth * 2)
        return out

    @staticmethod
    def _kth(scores, rows, left, k, own):
        """The k-th best score of each open query among the rows seen."""
        s = scores[np.ix_(rows, left)]
        top = np.sort(-s, axis=0)[:k + 1] if s.dtype == object else np.sort(np.partition(-s, k, axis=0)[:k + 1], axis=0)
        # one more than k: the query's own row may be among the best
        at = np.minimum(np.searchsorted(rows, own[left]), len(rows) - 1)
        within = (rows[at] == own[left]) & (-s[at, np.arange(len(left))] <= top[k - 1])
        return -np.where(within, top[k], top[k - 1])

    @staticmethod
    def _best(score, rows, k, own):
        rows = rows[rows != own]
        s = score[rows]
        if len(rows) > k and s.dtype != object:
            cut = np.partition(s, len(s) - k)[len(s) - k]
            rows, s = rows[s >= cut], s[s >= cut]
        best = sorted(range(len(rows)), key=lambda r: (-s[r], rows[r]))[:k]
        return rows[best], s[best]


def _search(k: int):
    def run(key, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        vectors = vectors.sort_values("id", kind="stable")
        sizes, wanted = vectors["v"].map(len).to_numpy(), queries["v"].map(len).to_numpy()
        for d in np.unique(wanted):
            part, ask = vectors[sizes == d], queries[wanted == d]
            if not len(part):
                continue
            ids = part["id"].to_numpy()
            lists = Lists(np.stack(part["v"].to_list()))
            for at in range(0, len(ask), GROUP):
                q = ask.iloc[at:at + GROUP]
                qid, w = q["id"].to_numpy(), np.stack(q["v"].to_list())
                place = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
                own = np.where(ids[place] == qid, place, -1)
                for i, (best, s) in enumerate(lists.top(w, k, own)):
                    out.append(pd.DataFrame({"query_id": qid[i], "vec_id": ids[best], "score": np.array([int(v) for v in s], dtype=np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k rows of ``vectors`` (id, v: array of whole doubles) with the highest
    inner product for each row of ``queries`` (the same columns); ties go to
    the smaller id, and a row with the query's id is not its result.

    Returns query_id, rank (from 1), vec_id, score.  Vectors of another length
    than the query's are not compared.  Repeated rows count once; a score
    beyond the longs is the nearest long, also for the order.  Empty
    tables give empty results; a query with fewer candidates gets them all.
    """
    n, m = vectors.count(), queries.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    own = vectors.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    ask = queries.select("id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                         F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("part"))
    found = own.groupBy("block", "part").cogroup(ask.groupBy("block", "part")).applyInPandas(
        _search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """``search`` over the usable rows of ``embeddings`` (vec_id, embedding),
    in integers; the queries are the rows whose vec_id ``every`` divides.
    Rows with a null vec_id, and vectors that are null or empty or hold null
    or non-finite components, take no part; finite components count whole,
    however large (a product beyond the doubles as the largest one)."""
    rows = materialize(
        embeddings.where(F.col("vec_id").isNotNull() & fit(F.col("embedding")))
        .select(F.col("vec_id").alias("id"), integers(F.col("embedding")).alias("v")).distinct(), "vectors")
    return search(rows, rows.where(F.col("id") % every == 0), k)
