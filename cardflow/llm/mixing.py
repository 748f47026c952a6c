"""Mixing sources to target weights by a low-discrepancy schedule.

Everything here is DataFrame work; nothing leaves the JVM.

* Targets.  Sources, in code point order (null last), weigh ``weights`` in
  turn and share ``share`` times all words; a source stops at ``most`` times
  its own words and the excess is shared again by weight until none is above.
* Blocks.  The documents of a source, shuffled by a hash, form one stream of
  words that is cut into blocks of ``block`` words (the last one shorter).
* Schedule.  A source weighs its quota, the number of blocks its target
  takes; laid end to end the quotas are the cumulative weights.  Slot i
  stands at the van der Corput point of i (its bits reversed), scaled to the
  cumulative weights, and belongs to the source it falls into.  Points are
  distinct, so a source gets its quota of slots, and any run of slots holds
  the sources in proportion.  The rank of a slot among its source's slots
  names the block it takes, in passes over the source's stream; the last
  block of a target is cut, so every source gets its target, rounded.

A source with a third of all rows is split everywhere: streams are summed in
two levels, slots are made and ranked in slices, and blocks join on
(source, block).

Null and empty texts have size 0 and are never taken; an empty table gives an
empty result.  Repeated rows are documents of their own.  Equal inputs give
equal results.  Only scalars reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardflow.llm.common import CHUNK_BITS, gapless, with_row_id
from cardflow.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 1024
ROWS_PER_SLICE = 8192
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of characters other than the ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before this one."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of the sources of ``sizes`` (source, size): sid (position in
    code point order, null last), source, source_size, weight, target."""
    per = materialize(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .orderBy(F.col("source").asc_nulls_last())
        .withColumn("rid", F.monotonically_increasing_id()), "sources")
    # parts of the sorted table are ranges: one starts where those before it end
    part = per.withColumn("part", F.shiftright("rid", 33))
    starts = _running(part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1)),
                      ["one"], ["part"], "n", "first").select("part", "first")
    sid = (F.col("first") + F.col("rid").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.col("sid") % len(weights)).cast("int") + 1)
    src = materialize(part.join(starts, "part").withColumn("sid", sid)
                      .select("sid", "source", "source_size", pick.alias("weight")), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1.0
    while level != seen:  # a higher level stops more sources, so this ends
        seen = level
        full = F.col("weight") * F.lit(level) > cap
        r = src.agg(F.sum(F.when(full, cap)).alias("given"),
                    F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r["open"]:
            level = max(level, (share * total - (r["given"] or 0.0)) / r["open"])
    return src.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def reverse_bits(x: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a long in reverse order."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F),
                        (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        low = F.lit(mask)
        x = F.shiftrightunsigned(x, shift).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(low), shift))
    return F.shiftrightunsigned(x, 64 - bits)


def schedule(src: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: sid, slot (the order of the schedule; with
    gaps), rank, block (its number in the source's stream), pass (from 0),
    lo and hi (the words of the stream it takes).  ``src``: see ``targets``."""
    q = src.where("source_size > 0").select(
        "sid", "source_size", F.round("target").cast("long").alias("want"),
        F.ceil(F.col("source_size") / F.lit(block)).alias("blocks"))
    q = q.withColumn("quota", F.expr("want div source_size") * F.col("blocks")
                     + F.ceil((F.col("want") % F.col("source_size")) / F.lit(block))).where("quota > 0")
    q = q.withColumn("bag", F.expr("sid div 4096"))
    bags = _running(q.groupBy("bag").agg(F.sum("quota").alias("n")).withColumn("one", F.lit(1)),
                    ["one"], ["bag"], "n", "base").select("bag", "base")
    q = _running(q, ["bag"], ["sid"], "quota", "before").join(bags, "bag")
    q = materialize(q.withColumn("lower", F.col("base") + F.col("before")).drop("bag", "base", "before"), "quota")
    slots = q.agg(F.sum("quota")).first()[0] or 0
    bits = max(1, int(slots - 1).bit_length()) if slots else 1
    # a source's cells of the cumulative weights, in slices one task can make
    end = F.col("lower") + F.col("quota")
    slices = F.sequence(F.shiftright("lower", CHUNK_BITS), F.shiftright(end - 1, CHUNK_BITS))
    first = F.shiftleft("slice", CHUNK_BITS)
    cells = F.sequence(F.greatest("lower", first), F.least(end, first + F.lit(1 << CHUNK_BITS)) - 1)
    at = (q.select("*", F.explode(slices).alias("slice")).repartition("sid", "slice")
          .select("sid", "source_size", "want", "blocks", F.explode(cells).alias("cell"))
          .withColumn("slot", reverse_bits(F.col("cell"), bits)).drop("cell"))
    ranked = gapless(at, ["sid"], "slot", "rank")
    lo = F.col("block") * F.lit(block)
    before = F.col("pass") * F.col("source_size") + lo
    take = F.least(F.lit(block), F.col("source_size") - lo, F.col("want") - before)
    return (ranked.withColumn("block", F.col("rank") % F.col("blocks"))
            .withColumn("pass", F.expr("rank div blocks"))
            .select("sid", "slot", "rank", "block", "pass", lo.alias("lo"), (lo + take).alias("hi")))


def streams(rows: DataFrame) -> DataFrame:
    """Place documents in their source's stream.  ``rows``: rid, sid, size and
    order (a long that shuffles); adds start (the words before it)."""
    slices = max(1, -(-rows.count() // ROWS_PER_SLICE))
    rows = rows.withColumn("slice", F.pmod("order", F.lit(slices)))
    starts = _running(rows.groupBy("sid", "slice").agg(F.sum("size").alias("n")),
                      ["sid"], ["slice"], "n", "base").select("sid", "slice", "base")
    inside = _running(rows, ["sid", "slice"], ["order", "rid"], "size", "inside")
    return (inside.join(starts, ["sid", "slice"])
            .withColumn("start", F.col("base") + F.col("inside")).drop("slice", "inside", "base"))


def takes(rows: DataFrame, src: DataFrame, block: int = BLOCK) -> DataFrame:
    """What the schedule takes of each document: rid, pass, taken (words, from
    the document's first; 0 and a null pass if nothing), slot (the one that
    takes the first of them; null if nothing) and start (in the stream)."""
    a, b = F.col("start"), F.col("start") + F.col("size")
    blocks = F.when(F.col("size") > 0, F.sequence(
        F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    pieces = streams(rows).select("rid", "sid", a.alias("a"), b.alias("b"), F.explode_outer(blocks).alias("block"))
    met = pieces.join(schedule(src, block), ["sid", "block"], "left")
    # no slot took the block: least() would pass over the null
    part = F.when(F.col("hi").isNotNull(), F.greatest(F.least("b", "hi") - F.greatest("a", "lo"), F.lit(0)))
    # slots of a pass go up with its blocks, so the least has the first word
    return met.groupBy("rid", "pass").agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("taken"),
                                          F.min(F.when(part > 0, F.col("slot"))).alias("slot"),
                                          F.min("a").alias("start"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"),
                       F.xxhash64("doc_id", "text").alias("order"))


def _with_sid(rows: DataFrame, src: DataFrame) -> DataFrame:
    return rows.join(src.select("sid", F.col("source").alias("__s")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def mix_report(docs: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and
    slot (the first that takes a word; null if none does) of every row of
    ``docs`` (doc_id, text, source)."""
    rows = with_row_id(_sized(docs), "rid")
    src = targets(rows, **how)
    rows = _with_sid(rows, src)
    taken = takes(rows, src, block).groupBy("rid").agg(F.sum("taken").alias("taken"), F.min("slot").alias("slot"))
    return (rows.join(taken, "rid").join(src.select("sid", "source_size", "target"), "sid")
            .select("doc_id", "size", "source_size", "target", "taken", "slot"))


def mix(docs: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """The mixed documents: every column of ``docs``, a row for each pass that
    takes a document, sorted by the schedule's slots.  A document is not cut
    where a block ends: it stands at the slot that takes its first word, and
    documents of one slot in the order of their stream.  Where the mix takes
    only its first words, text is those words joined by spaces."""
    base = with_row_id(docs, "__rid")
    rows = base.select(F.col("__rid").alias("rid"), "doc_id", "source", words(F.col("text")).alias("size"),
                       F.xxhash64("doc_id", "text").alias("order"))
    rows = materialize(rows, "sizes")
    src = targets(rows, **how)
    plan = (takes(_with_sid(rows, src), src, block).where("taken > 0")
            .join(rows.select("rid", "size"), "rid")
            .select(F.col("rid").alias("__rid"), F.col("size").alias("__size"), F.col("taken").alias("__taken"),
                    F.col("slot").alias("__slot"), F.col("start").alias("__start")))
    part = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)),
                                    F.lit(1), F.col("__taken").cast("int")))
    text = F.when(F.col("__taken") == F.col("__size"), F.col("text")).otherwise(part)
    return (base.join(plan, "__rid").withColumn("text", text)
            .orderBy("__slot", "__start", "__rid").select(*docs.columns))
