import hashlib
import itertools
import random
import zlib

import pytest

from cardflow.llm import conversation_repair as C

COLS = "conv_id long, turn long, role string, text string, rid string, part long, audit string"


def conv_df(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, "K") for r in rows], COLS)


def full_chart(row_kinds):
    """CYK over all spans and all splits; the cell of the whole."""
    n = len(row_kinds)
    chart = {(i, i + 1): C.terminal(*k) for i, k in enumerate(row_kinds)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cell = {}
            for k in range(i + 1, i + size):
                for pair, new in C.combine(chart[i, k], chart[k, i + size]).items():
                    cell[pair] = min(cell.get(pair, new), new)
            chart[i, i + size] = cell
    return chart[0, n] if n else C.CLOSURE


def cheapest(row_kinds):
    """All edits of all rows with up to two insertions between any two rows,
    by dynamic programming over (state) with sets of audits, no grammar."""
    now = {"E": {(0, "")}}

    def insert(now):
        for _ in range(2):
            grown = {k: set(v) for k, v in now.items()}
            for p, found in now.items():
                for kind in "ua":
                    if p in C.MOVES[kind]:
                        grown.setdefault(C.MOVES[kind][p], set()).update((c + 2, a + "I") for c, a in found)
            now = grown
        return now

    for initial, fault in row_kinds:
        after = {}
        for p, found in insert(now).items():
            for c, a in found:
                after.setdefault(p, set()).add((c + 3, a + "D"))
                if fault in (1, 2):
                    continue
                more = fault == 3
                for kind in "sua":
                    if p in C.MOVES[kind]:
                        q = C.MOVES[kind][p]
                        if initial == kind:
                            after.setdefault(q, set()).add((c + more, a + "K"))
                        if kind != "s":
                            after.setdefault(q, set()).add((c + 2 + more, a + "R"))
        now = {p: set(sorted(v)[:400]) for p, v in after.items()}
    now = insert(now)
    return min(min(now[p]) for p in "EA" if p in now)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_all_short_conversations(n):
    for kinds in itertools.product(itertools.product(["s", "u", "a", "x", ""], range(4)), repeat=n):
        cell = C.CLOSURE
        for k in kinds:
            cell = C.combine(cell, C.terminal(*k))
        assert C.repair_of(cell) == cheapest(kinds)


@pytest.mark.parametrize("seed", range(30))
def test_any_split_gives_the_full_charts_minimum(seed):
    rng = random.Random(seed)
    kinds = [(rng.choice("suauauax"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 22))]
    chart = C.Chart()
    for i, (initial, fault) in enumerate(kinds):
        chart.row(i, initial, fault, C.terminal(initial, fault))
    out = chart.out()
    whole = full_chart(kinds)
    assert {p: (c, a) for p, c, a in zip(C.PAIRS, out["costs"], out["audits"]) if c is not None} == whole
    if len(kinds) <= 12:
        assert C.repair_of(whole) == cheapest(kinds)


def brute(rows):
    """The report's rows, by definition, with the full chart."""
    every, convs = [], {}
    for conv, turn, role, text in rows:
        if conv not in every:
            every.append(conv)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        convs.setdefault(conv, []).extend([(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    out = set()
    for conv in every:
        seen, kinds, counts = set(), [], [0] * 4
        lines = sorted(convs.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0))
        for _, role, text in lines:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            kinds.append((role[:1], fault))
            counts[fault] += 1
        turns = [t for t, _, _ in lines if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit = C.repair_of(full_chart(kinds))
        made, left, last = [], list(lines), ""
        for e in audit:
            if e != "I":
                _, role, text = left.pop(0)
            turn = "user" if last != "u" else "assistant"
            if e != "D":
                made.append((role, text) if e == "K" else (turn, "" if e == "I" else text))
                last = made[-1][0][0]
        out.add((conv, gaps, *counts[1:], illegal, cost, audit,
                 hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()))
    return out


def rows_of(rng, convs, longest):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["system"] if t == 0 and rng.random() < .4 else ["user", "assistant", "assistant", "tool", "", None, "s"])
            text = rng.choice(["Yes.", "No!", "why?  ", "cut", "", " \t", None, "é.", "long " * 50 + ".", f"t{rng.random()}."])
            rows.append((c, t if rng.random() < .9 else rng.choice([None, 0, t + 5]), role, text))
    return rows


def report(df):
    return {tuple(r) for r in C.repair_report(df).collect()}


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 6)])
def test_report_against_brute_force(spark, seed, parts):
    rows = rows_of(random.Random(seed), 60, 9) + [(None, 0, "user", "Hi."), (None, None, "assistant", None), (900, None, "user", "A.")]
    df = conv_df(spark, rows)
    assert report(df if parts == 1 else df.repartitionByRange(parts, "conv_id")) == brute(rows)


def test_a_conversation_of_a_third_of_all_rows(spark):
    rng = random.Random(3)
    hot = [(5, t, rng.choice(["user", "assistant"]), f"{rng.random()}{rng.choice('.x')}") for t in range(120)]
    rows = hot + [(100 + r[0], *r[1:]) for r in rows_of(rng, 60, 6)]
    assert report(conv_df(spark, rows).repartition(5).orderBy("conv_id", "turn")) >= brute(hot)


def test_joining_parts_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "SPAN", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(90)]
        numbered = C.number_rows(conv_df(spark, rows).coalesce(1))
        (got,) = C.parse(numbered).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    kinds = [(r[2][:1], 0) for r in rows]
    chart = C.Chart()
    for (initial, fault), r in zip(kinds, rows):
        chart.row(r[1], initial, fault, C.terminal(initial, fault))
    out = chart.out()
    assert (got["cost"], got["audit"]) == C.repair_of(dict(zip(C.PAIRS, zip(out["costs"], out["audits"]))) | {"EE": (270, "D" * 90)})
    assert (got["gaps"], got["illegal"]) == (0, 0)


def test_repaired_rows_have_the_legal_shape(spark):
    rows = rows_of(random.Random(4), 40, 8)
    turns = {}
    for r in C.repair(conv_df(spark, rows).coalesce(1)).collect():
        turns.setdefault(r["conv_id"], []).append((r["position"], r["role"], r["edit"], r["turn"]))
    for t in turns.values():
        t.sort()
        assert [p for p, *_ in t] == list(range(len(t)))
        roles = "".join(r[:1] for _, r, _, _ in t).removeprefix("s")
        assert roles == "ua" * (len(roles) // 2) and roles
        assert all((turn is None) <= (edit in "IKR") for _, _, edit, turn in t)


def test_empty(spark):
    df = conv_df(spark, [])
    assert C.repair_report(df).count() == 0 and C.repair(df).count() == 0
    dropped = next(t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (r,) = C.repair_report(conv_df(spark, [(1, dropped, "user", "a.")])).collect()
    assert tuple(r) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
