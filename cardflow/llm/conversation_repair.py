"""Conversation structure repair by weighted CYK interval parsing.

The roles of a conversation should read ``(s?(ua)+)?`` (initials).  The repair
grammar generates the rows of a damaged conversation with edits: Keep (0),
Rerole to user or assistant (2), Delete (3) and Insert (2).  Its nonterminals
are pairs ``pq`` of what stands before and after a span (E: nothing yet, S: a
system turn, U: a user's, A: an assistant's), its rules in Chomsky normal form
``pq -> pr rq``, and a row's own edits are the terminals.  A cell holds for each
nonterminal the cheapest edits of its span as (cost, audit), ties going to the
ASCII-least audit; insertions before and after a row are closed over in its
cell, and cells so closed stay closed when they are combined.

Cells are combined bottom-up by span length.  As the rules have every ``r``,
any split of a span gives the same minimum (no audit of a span begins another
of the same cost, so the least parts make the least whole), and the chart is
filled for spans of 1, 2, 4, ... rows only: n - 1 combinations instead of n**2
cells.  The tests compare it with the full chart.

Rows are sorted over the whole table by conversation and turn.  A task combines
the rows of a conversation that lie in its range; only the first and the last
conversation of a range can go on in another, and their cells, one per range,
are combined by rounds of 32 in order.  So a conversation that holds a third of
all rows is parsed by as many tasks as hold it.  Its repaired digest is of one
message and must be taken in order: its rows stream through one task, sorted,
in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflow.llm.common import with_row_id
from cardflow.session import materialize

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
SPAN = 32
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LONG = 2**63 - 1

STATES = "ESUA"
#: The nonterminals: from a state to one that can follow it.
PAIRS = [p + q for p in STATES for q in STATES if q in {"E": "ESUA", "S": "SUA", "U": "UA", "A": "UA"}[p]]
RULES = [(p + q, [(p + r, r + q) for r in STATES if p + r in PAIRS and r + q in PAIRS]) for p, q in PAIRS]
#: Where a turn of each kind may stand, and what stands after it.
MOVES = {"s": {"E": "S"}, "u": {"E": "U", "S": "U", "A": "U"}, "a": {"U": "A"}}
NAMES = {"u": "user", "a": "assistant"}


def combine(left: dict, right: dict) -> dict:
    """The cell of two spans next to each other."""
    out = {}
    for pair, splits in RULES:
        best = None
        for a, b in splits:
            if a in left and b in right:
                (x, s), (y, t) = left[a], right[b]
                if best is None or x + y <= best[0]:
                    new = (x + y, s + t)
                    if best is None or new < best:
                        best = new
        if best is not None:
            out[pair] = best
    return out


def _insertions() -> dict:
    """The cell of no row: any insertions."""
    cell = {p + p: (0, "") for p in STATES}
    for kind in NAMES:
        for p, q in MOVES[kind].items():
            cell[p + q] = (INSERT, "I")
    return combine(cell, cell)


CLOSURE = _insertions()


def terminal(initial: str, fault: int) -> dict:
    """The cell of one row, insertions before and after it closed over."""
    cell = {p + p: (DELETE, "D") for p in STATES}
    if fault not in (BLANK, DUPLICATE):
        more = CUT_SHORT if fault == TRUNCATED else 0
        edits = [(k, REROLE + more, "R") for k in NAMES]
        if initial in MOVES:
            edits.append((initial, KEEP + more, "K"))
        for kind, cost, letter in edits:
            for p, q in MOVES[kind].items():
                cell[p + q] = min(cell.get(p + q, (LONG, "")), (cost, letter))
    return combine(combine(CLOSURE, cell), CLOSURE)


def repair_of(cell: dict) -> tuple[int, str]:
    """The cheapest edits of a whole conversation."""
    return min(cell["EE"], cell["EA"])


class Chart:
    """Cells of spans of 1, 2, 4, ... rows, combined as soon as two of a
    length stand next to each other, and what is counted along the way."""

    def __init__(self):
        self.spans: list[tuple[int, dict]] = []
        self.first = self.last = None
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.faults = [0, 0, 0, 0]

    def _push(self, n: int, cell: dict) -> None:
        while self.spans and self.spans[-1][0] <= n:
            m, before = self.spans.pop()
            n, cell = m + n, combine(before, cell)
        self.spans.append((n, cell))

    def _meet(self, initial: str) -> None:
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")

    def row(self, turn, initial: str, fault: int, cell: dict) -> None:
        self._meet(initial)
        self.first = initial if self.first is None else self.first
        self.last = initial
        self.faults[fault] += 1
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self._push(1, cell)

    def follow(self, other: dict) -> None:
        """Take in the chart (a row of ``SCHEMA``) that comes next."""
        self._meet(other["first"])
        self.first = other["first"] if self.first is None else self.first
        self.last = other["last"]
        self.illegal += other["illegal"]
        self.faults = [a + b for a, b in zip(self.faults, [0, other["blank"], other["duplicate"], other["truncated"]])]
        if other["low"] is not None:
            self.turns += other["turns"] - (self.high == other["low"])
            self.low = other["low"] if self.low is None else self.low
            self.high = other["high"]
        self._push(other["n"], {p: (c, t) for p, c, t in zip(PAIRS, other["costs"], other["audits"]) if c is not None})

    def out(self) -> dict:
        cell, n = CLOSURE, 0
        for m, c in self.spans:
            n, cell = n + m, combine(cell, c)
        return {"n": n, "costs": [cell.get(p, (None, None))[0] for p in PAIRS],
                "audits": [cell.get(p, (None, None))[1] for p in PAIRS], "first": self.first, "last": self.last,
                "low": self.low, "high": self.high, "turns": self.turns, "illegal": self.illegal,
                "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED]}


SCHEMA = ("conv_id long, part long, whole boolean, n long, costs array<long>, audits array<string>, first string, "
          "last string, low long, high long, turns long, illegal long, blank long, duplicate long, truncated long")
ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()),
                   ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("first", pa.string()),
                   ("last", pa.string()), *[(c, pa.int64()) for c in (
                       "low", "high", "turns", "illegal", "blank", "duplicate", "truncated")]])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a sorted range; the first and the last
    may go on elsewhere."""
    part, leaves = TaskContext.get().partitionId(), {}
    chart, conv, out, first = None, None, [], True

    def close(whole: bool) -> None:
        out.append({"conv_id": conv, "part": part, "whole": whole, **chart.out()})

    for b in batches:
        for c, turn, initial, fault in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "initial", "fault"))):
            if chart is None or c != conv:
                if chart is not None:
                    close(not first)
                    first = False
                chart, conv = Chart(), c
            if (initial, fault) not in leaves:
                if len(leaves) > 10_000:
                    leaves.clear()
                leaves[initial, fault] = terminal(initial, fault)
            chart.row(turn, initial, fault, leaves[initial, fault])
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, ARROW)
            out.clear()
    if chart is not None:
        close(False)
    yield pa.RecordBatch.from_pylist(out, ARROW)


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Combine rows of one conversation and one part, which come in order."""
    chart, key = None, None
    for b in batches:
        for row in b.to_pylist():
            if chart is not None and key != (row["conv_id"], row["part"] // SPAN):
                yield pa.RecordBatch.from_pylist([{"conv_id": key[0], "part": key[1], "whole": False, **chart.out()}], ARROW)
                chart = None
            if chart is None:
                chart, key = Chart(), (row["conv_id"], row["part"] // SPAN)
            chart.follow(row)
    if chart is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": key[0], "part": key[1], "whole": False, **chart.out()}], ARROW)


def number_rows(conversations: DataFrame) -> DataFrame:
    """A written table of the rows (nulls of role and text: one space) with a
    row number ``rid`` that decides between rows of one turn: table order."""
    return with_row_id(conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")), "rid")


def parse(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (from ``number_rows``): conv_id,
    gaps, blank, duplicate, truncated, illegal, cost and audit."""
    # the first of equal rows of a conversation, found by a partial aggregate: a text that a third of them
    # share is one row per task
    firsts = (rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("text"))
              .agg(F.min(F.struct("turn", "rid"))["rid"].alias("rid")).select("rid", F.lit(True).alias("is_first")))
    marked = rows.join(firsts, "rid", "left").select(
        "conv_id", "turn", "rid", F.substring("role", 1, 1).alias("initial"),
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("is_first").isNull(), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0).alias("fault"))
    order = ["conv_id", "turn", "rid"]
    cells = materialize(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_parse, SCHEMA), "cells")
    open_ = cells.where("not whole")
    last = open_.agg(F.max("part")).first()[0] or 0
    while True:
        by = F.floor(F.col("part") / SPAN)
        open_ = open_.repartition("conv_id", by).sortWithinPartitions("conv_id", "part").mapInArrow(_join_parts, SCHEMA)
        last //= SPAN
        if not last:
            break
    whole = cells.where("whole").union(open_)
    at = {p: F.col("costs")[PAIRS.index(p)] for p in ("EE", "EA")}
    text = {p: F.col("audits")[PAIRS.index(p)] for p in ("EE", "EA")}
    best = F.least(F.struct(at["EE"].alias("cost"), text["EE"].alias("audit")),
                   F.struct(at["EA"].alias("cost"), text["EA"].alias("audit")))
    gaps = F.col("high").cast("decimal(20,0)") - F.col("low") + 1 - F.col("turns")
    return whole.select("conv_id", F.least(F.coalesce(gaps, F.lit(0)), F.lit(LONG)).cast("long").alias("gaps"),
                        "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


class Editor:
    """Applies an audit to the rows of one conversation in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, "E"

    def _next_kind(self) -> str:
        return "a" if self.state == "U" else "u"

    def insertions(self) -> Iterator[tuple[str, str, str]]:
        """What is inserted before the next row: edit, role, text."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            kind = self._next_kind()
            self.state = MOVES[kind][self.state]
            yield "I", NAMES[kind], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            kind = role[:1] if edit == "K" else self._next_kind()
            self.state = MOVES[kind][self.state]
            yield edit, role if edit == "K" else NAMES[kind], text


def _edited(emit):
    """Stream audits and rows, an audit before the rows of its conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = conv = None
        sink = emit()
        for b in batches:
            for c, audit, turn, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "audit", "turn", "role", "text"))):
                if audit is not None:
                    if editor is not None:
                        sink.lines(conv, None, editor.insertions())
                        sink.close(conv)
                    editor, conv = Editor(audit), c
                else:
                    sink.lines(conv, turn, editor.row(role, text))
            yield from sink.flush()
        if editor is not None:
            sink.lines(conv, None, editor.insertions())
            sink.close(conv)
        yield from sink.flush()
    return run


class _Digests:
    SCHEMA = "conv_id long, repaired_sha256 string"

    def __init__(self):
        self.sha, self.any, self.out = hashlib.sha256(), False, []

    def lines(self, conv, turn, made) -> None:
        for _, role, text in made:
            self.sha.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.any = True

    def close(self, conv) -> None:
        self.out.append({"conv_id": conv, "repaired_sha256": self.sha.hexdigest()})
        self.sha, self.any = hashlib.sha256(), False

    def flush(self):
        yield pa.RecordBatch.from_pylist(self.out, pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))
        self.out = []


class _Rows:
    SCHEMA = "conv_id long, position long, edit string, turn long, role string, text string"

    def __init__(self):
        self.n, self.out = 0, []

    def lines(self, conv, turn, made) -> None:
        for edit, role, text in made:
            self.out.append({"conv_id": conv, "position": self.n, "edit": edit, "turn": None if edit == "I" else turn,
                             "role": role, "text": text})
            self.n += 1

    def close(self, conv) -> None:
        self.n = 0

    def flush(self):
        yield pa.RecordBatch.from_pylist(self.out, pa.schema([
            ("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()),
            ("role", pa.string()), ("text", pa.string())]))
        self.out = []


def edit(rows: DataFrame, audits: DataFrame, emit=_Rows) -> DataFrame:
    """The repaired conversations, a row per turn in order of ``position``, from
    numbered rows and their audits (``_Digests``: their SHA-256 instead)."""
    none = F.lit(None)
    both = audits.select("conv_id", "audit", none.cast("long").alias("turn"), none.cast("string").alias("role"),
                         none.cast("string").alias("text"), none.cast("long").alias("rid")).union(
        rows.select("conv_id", none.cast("string").alias("audit"), "turn", "role", "text", "rid"))
    return (both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("rid").isNotNull(), "turn", "rid")
            .mapInArrow(_edited(emit), emit.SCHEMA))


def repair(conversations: DataFrame) -> DataFrame:
    """Repair every conversation of ``conversations`` (conv_id, turn, role,
    text): the repaired turns (conv_id, position, edit, turn, role, text).

    Rows go by turn, a null turn first and rows of one turn in table order.
    Null roles and texts are one space; a null conv_id is a conversation of
    its own.  A row's first fault counts: blank, duplicate (role and text
    earlier in the conversation), truncated (the last character that is not
    white space is none of ``.!?``); blank and duplicate rows are deleted.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = number_rows(conversations)
    return edit(rows, materialize(parse(rows), "audits"))


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with a fault in a quarter of their rows, decided by the
    CRC-32 of ``conv_id:turn`` (a null is one space)."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("fate"))
    text = (F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    return (rows.where("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
        .drop("copy"))


def repair_report(conversations: DataFrame) -> DataFrame:
    """Damage every conversation and repair it: what was found in each, the
    cheapest edits and the SHA-256 of the repaired ``role:text`` lines.  A
    conversation without rows left has zeros and the digest of nothing."""
    rows = number_rows(damage(conversations))
    audits = materialize(parse(rows), "audits")
    digests = edit(rows, audits, _Digests)
    same = audits["conv_id"].eqNullSafe(digests["conv_id"])
    found = audits.join(digests, same).drop(digests["conv_id"]).withColumnRenamed("conv_id", "of")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, every["conv_id"].eqNullSafe(found["of"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The same rows by a left-to-right recursion: for each row the cheapest edits
#: so far that end in each state, as (cost and audit, repaired lines).
SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         row_number() OVER () AS line,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), fated AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 20 AS fate
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         line, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fated WHERE fate <> 0
), marked AS (
  SELECT *, row_number() OVER w AS i,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, line, copy) > 1 THEN 2
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
         left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, line, copy)
), found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, max(i) AS n,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), steps AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 't': ''} AS e, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s,
         NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS u, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS a
  FROM found
  UNION ALL
  SELECT conv_id, i,
    {'c': e.c + 3, 'a': e.a || 'D', 't': e.t},
    list_min([CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'a': s.a || 'D', 't': s.t} END,
              CASE WHEN open AND initial = 's' THEN {'c': e.c + short, 'a': e.a || 'K', 't': e.t || own} END]),
    list_min([{'c': u.c + 3, 'a': u.a || 'D', 't': u.t},
              CASE WHEN open AND initial = 'u' THEN {'c': b.c + short, 'a': b.a || 'K', 't': b.t || own} END,
              CASE WHEN open THEN {'c': b.c + 2 + short, 'a': b.a || 'R', 't': b.t || chr(10) || 'user:' || text} END]),
    list_min([{'c': a.c + 3, 'a': a.a || 'D', 't': a.t},
              CASE WHEN open AND initial = 'a' THEN {'c': u.c + short, 'a': u.a || 'K', 't': u.t || own} END,
              CASE WHEN open THEN {'c': u.c + 2 + short, 'a': u.a || 'R', 't': u.t || chr(10) || 'assistant:' || text} END])
  FROM (
    SELECT *, list_min([a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}]) AS a,
           list_min([e, s, a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}]) AS b
    FROM (
      SELECT p.conv_id, m.i, m.initial, m.text, chr(10) || m.role || ':' || m.text AS own, m.fault IN (0, 3) AS open,
             CASE WHEN m.fault = 3 THEN 1 ELSE 0 END AS short, p.e, p.s, p.a,
             list_min([p.u, {'c': (list_min([p.e, p.s, p.a])).c + 2, 'a': (list_min([p.e, p.s, p.a])).a || 'I',
                             't': (list_min([p.e, p.s, p.a])).t || chr(10) || 'user:'}]) AS u
      FROM steps p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1)
  )
), finished AS (
  SELECT f.*, list_min([e, a, {'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'},
                        {'c': s.c + 4, 'a': s.a || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}]) AS best
  FROM steps JOIN found f ON f.conv_id IS NOT DISTINCT FROM steps.conv_id AND f.n = steps.i
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN finished ON finished.conv_id IS NOT DISTINCT FROM c.conv_id
"""
