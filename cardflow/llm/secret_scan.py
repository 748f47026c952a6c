"""Secret scans: patterns, and an assignment-aware lexer.

Three fixed patterns give the base spans (kinds assign, access and hex).  The
lexer adds kind ``named``: it reads the assignments of source and
configuration syntax as (name, value) pairs,

    name = "literal"    name: 'literal'    name := literal    name => "literal"
    "name": "literal"   export NAME=literal   <name>literal</name>
    #define NAME "literal"   name = OTHER_NAME   name = "part" + OTHER_NAME

binds every name to the literals its value is made of, follows names to the
literals they were bound to before (constants propagate through any number of
assignments), and scores each literal by how sensitive the name it reaches is
and by how much it looks like a secret: its length, its kinds of characters
and their entropy, and that it is no placeholder.  A literal is a finding if
name and looks together reach ``NAMED_SCORE`` and no base span covers it.

Offsets count code points; ends are exclusive.  Null and empty texts have no
spans; texts are scanned whole; a text without an assignment's sign is not lexed.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "named")
BASE = KINDS[:3]

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: How sensitive a target name is: the weight of the words found in it.
NAME_WEIGHT = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3,
    "apikey": 3, "credential": 3, "credentials": 3, "privatekey": 3, "accesskey": 3, "authkey": 3,
    "auth": 1, "bearer": 2, "key": 1, "api": 1, "access": 1, "private": 1, "signing": 1, "encryption": 1,
    "client": 1, "salt": 2, "pin": 1, "cookie": 1, "session": 1,
}
#: Names that only mention a secret.
HARMLESS = {"length", "len", "name", "type", "size", "count", "id", "url", "path", "file", "field", "label",
            "hint", "prompt", "policy", "format", "expiry", "ttl", "public"}
PLACEHOLDER = re.compile(
    r"(?i)^(x+|\*+|\.+|-+|_+|changeme|change_me|example|dummy|test|none|null|true|false|undefined|todo|"
    r"your[_-].*|my[_-]?(password|secret|token).*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\).*|\$[A-Za-z_]\w*)$")
NAMED_SCORE = 5.0

#: A name is read whole (no giving back), and only from its start, so long
#: texts without an operator cost one pass.
_NAME = r"(?>[A-Za-z_$][\w$]*(?:[.\-][A-Za-z_$][\w$]*)*)"
_ITEM = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[^\s"'`,;(){}\[\]<>#&|+]+)"""
#: One assignment: a name, an operator, and values joined by + or .
PAIR = re.compile(
    rf"""(?<![\w$])(?<![\w$][.\-])(?P<q>["']?)(?P<name>{_NAME})(?P=q)(?:\[["'](?P<index>[\w.\-]+)["']\])?"""
    rf"""(?:[ \t]*:[ \t]*[A-Za-z_][\w.\[\]]*(?=[ \t]*=[^=]))?"""
    rf"""[ \t]*(?:=>|:=|==?=?|:)[ \t]*(?P<value>{_ITEM}(?:[ \t]*\+[ \t]*{_ITEM})*)""")
DEFINE = re.compile(rf"#[ \t]*define[ \t]+(?P<name>{_NAME})[ \t]+(?P<value>{_ITEM})")
ELEMENT = re.compile(rf"<(?P<name>{_NAME})(?:[ \t][^<>\n]*)?>(?P<value>[^<>\n]+)</(?P=name)>")
_PART = re.compile(_ITEM)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns: leftmost, non-overlapping
    matches of each kind, those too short dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
                if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                if m.end() - m.start() >= LEAST["access"]]
    if _has_hex_run(text):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)
                if m.end() - m.start() >= LEAST["hex"]]
    return out


_HEX_TABLE = bytes(ord("x") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))


def _has_hex_run(text: str) -> bool:
    return b"x" * LEAST["hex"] in text.encode("utf-8", "surrogatepass").translate(_HEX_TABLE)


def name_score(name: str) -> int:
    """How sensitive a target name is, by its words in any naming style."""
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:])}
    if words and words[-1] in HARMLESS:
        return 0
    return sum(NAME_WEIGHT.get(w, 0) for w in {*words, *joined})


def looks_secret(literal: str) -> float:
    """How much a literal looks like a secret: 0 for placeholders, prose and
    short values; up to 3."""
    if len(literal) < 8 or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    kinds = sum((any(c.islower() for c in literal), any(c.isupper() for c in literal),
                 any(c.isdigit() for c in literal), any(not c.isalnum() for c in literal)))
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in (literal.count(c) for c in set(literal)))
    if kinds < 2 and entropy < 3.5:
        return 0.0
    return min(3.0, (kinds - 1) * 0.75 + max(0.0, entropy - 2.0))


def _unquote(part: str, at: int) -> tuple[str, int, int, bool]:
    """The text of a value part, its span, and whether it was quoted."""
    if len(part) > 1 and part[0] in "\"'`" and part[-1] == part[0]:
        return part[1:-1], at + 1, at + len(part) - 1, True
    return part, at, at + len(part), False


def named_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name through assignments."""
    if not ("=" in text or ":" in text or "define" in text or "</" in text):
        return []  # none of the three forms can match
    bound: dict[str, int] = {}  # a name's latest binding
    weight: list[int] = []  # of each binding: the most sensitive name it reaches
    literals: list[list[tuple[str, int, int]]] = []
    sources: list[list[int]] = []  # the bindings that a binding's value names
    pairs = sorted([*PAIR.finditer(text), *DEFINE.finditer(text), *ELEMENT.finditer(text)],
                   key=lambda m: (m.start("value"), m.end("value")))
    for m in pairs:
        name = (m.groupdict().get("index") or m.group("name")).rsplit(".", 1)[-1]
        own, refs, at = [], [], m.start("value")
        parts = [m.group("value")] if m.re is ELEMENT else _PART.findall(m.group("value"))
        for p in parts:
            start = text.index(p, at)
            at = start + len(p)
            value, i, j, quoted = _unquote(p, start)
            ref = None if quoted else bound.get(value.rsplit(".", 1)[-1])
            if ref is not None:
                refs.append(ref)
            elif value:
                own.append((value, i, j))
        bound[name] = len(weight)
        weight.append(name_score(name))
        literals.append(own)
        sources.append(refs)
    # values name earlier bindings only, so one pass from the end carries the
    # names' weights to every literal they are made of
    for k in range(len(weight) - 1, -1, -1):
        for r in sources[k]:
            weight[r] = max(weight[r], weight[k])
    found = set()
    for w, own in zip(weight, literals):
        if w >= 2:
            found.update((i, j, "named") for value, i, j in own if NAMED_SCORE - w <= (looks_secret(value) or -9))
    return sorted(found)


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """All spans of a text, by start, then kind as listed in ``KINDS``."""
    if not text:
        return []
    out = base_spans(text)
    base = sorted((i, j) for i, j, _ in out)
    starts, ends = [i for i, _ in base], list(accumulate((j for _, j in base), max))
    for s in named_spans(text):
        before = bisect_right(starts, s[0])
        if not before or ends[before - 1] < s[1]:
            out.append(s)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_column():
    """A Column function: the spans of a text, an array of (kind, start, end)."""
    @F.pandas_udf("array<struct<kind: string, start: int, end: int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": i, "end": j} for i, j, k in find_spans(t)] for t in texts],
                            dtype=object)
    return scan


def redact_column(mark: str = "[SECRET]"):
    """A Column function: the text with the secrets of its spans replaced (of
    an assignment, only its value); null stays null."""
    @F.pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redacted(t, mark) if isinstance(t, str) else None for t in texts], dtype=object)
    return redact


def redacted(text: str, mark: str = "[SECRET]") -> str:
    cuts = []
    for start, end, kind in find_spans(text):
        if kind == "assign":
            start = ASSIGN.match(text, start).start(2)
        cuts.append((start, end))
    out, at = [], 0
    for start, end in sorted(cuts):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every row of ``docs`` (doc_id, text).  Repeated
    rows are scanned each; an empty table gives an empty result."""
    return docs.select("doc_id", scan_column()("text").alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as
    kind:start:end, joined by commas) and spans (all, joined likewise)."""
    found = find_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] != "named")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced and ``n_chars`` counted
    anew; all rows and columns stay."""
    return docs.withColumn("text", redact_column()("text")).withColumn(
        "n_chars", F.length("text").cast("long")).select(*docs.columns)


def digest(spans: list[tuple[int, int, str]]) -> str:
    """base_sha256 of a list of base spans (for checks)."""
    return hashlib.sha256(",".join(f"{k}:{i}:{j}" for i, j, k in spans).encode()).hexdigest()
