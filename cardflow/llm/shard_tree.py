"""Sharding by a hierarchical weighted hash tree.

A document descends region -> rack -> shard.  At each node every child draws
``-ln(u) / weight`` from the document's key and the child's own name, and the
lowest draw wins, so a child is taken in proportion to its weight (the sum of
the shards below it) and a draw never depends on its siblings.  When a weight
changes, only draws of the nodes on that path change: rows move only into (or
out of) the subtrees whose weights changed.  ``grow`` adds the new shard as a
region of its own, so rows move only into the new shard.

The placement is a Column: no shuffle, no state, any number of rows per key.
Null keys are one key.  Extra columns are kept; a column named like an added
one is replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflow.llm.common import gapless, uniform, with_row_id


@dataclass(frozen=True)
class Node:
    """A region, rack or shard.  A shard has an id and a weight, the others
    have children; names must be unique in the tree."""
    name: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    weight: float = 1.0

    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total() for c in self.children)

    def shards(self) -> list[int]:
        return [self.shard] if self.shard is not None else [s for c in self.children for s in c.shards()]


def tree(n: int, racks: int = 2, per_rack: int = 2, weights: dict[int, float] | None = None) -> Node:
    """Shards 0 to n - 1, ``per_rack`` to a rack and ``racks`` racks to a region."""
    if n < 1:
        raise ValueError("a tree needs at least one shard")
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(n):
        w = float((weights or {}).get(s, 1.0))
        if w <= 0:
            raise ValueError("weights must be positive")
        region, rack = s // (racks * per_rack), s // per_rack
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"shard{s}", (), s, w))
    return Node("root", tuple(
        Node(f"region{r}", tuple(Node(f"region{r}/rack{k}", tuple(shards)) for k, shards in rk.items()))
        for r, rk in regions.items()))


def grow(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    s = max(root.shards()) + 1
    leaf = Node(f"shard{s}", (), s, weight)
    region = Node(f"region+{s}", (Node(f"region+{s}/rack", (leaf,)),))
    return Node(root.name, (*root.children, region))


def place(key: Column, node: Node) -> Column:
    """The shard (int) that ``key`` descends to."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return place(key, node.children[0])
    draws = F.array_min(F.array(*(
        F.struct((-F.log(uniform(c.name, key)) / F.lit(c.total())).alias("draw"), F.lit(i).alias("child"))
        for i, c in enumerate(node.children))))["child"]
    out = None
    for i, c in enumerate(node.children[:-1]):
        out = F.when(draws == i, place(key, c)) if out is None else out.when(draws == i, place(key, c))
    return out.otherwise(place(key, node.children[-1]))


def assign(docs: DataFrame, key: str, root: Node, name: str = "shard") -> DataFrame:
    """``docs`` with the shard of every row (int)."""
    return docs.withColumn(name, place(F.col(key), root))


def write_shards(docs: DataFrame, key: str, root: Node, path: str) -> None:
    """Write every row, text included, below ``path``/shard=N.  No shuffle:
    each task writes its rows of each shard."""
    assign(docs, key, root).write.mode("overwrite").partitionBy("shard").parquet(path)


def layout(docs: DataFrame, root: Node) -> DataFrame:
    """The shard map of ``docs`` (doc_id, text): doc_id, size (UTF-8 bytes of
    the text, null: none, plus 1), text_crc32 (of those bytes; a null text
    has none, so 0), shard, slot (position in its shard, gapless from 0) and
    grown_shard (with one more shard).  Repeated rows each get a slot."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"),
                       place(F.col("doc_id"), root).alias("shard"),
                       place(F.col("doc_id"), grow(root)).alias("grown_shard"))
    return gapless(with_row_id(rows, "__rid"), ["shard"], "__rid", "slot").drop("__rid")
