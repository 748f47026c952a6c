"""Small inputs with the odd cases every operator must take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, id long, keys string"


def docs_df(spark, rows, schema: str = DOCS):
    """Documents from (doc_id, text[, source]) with extra columns whose names
    operators might use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), -1, -2, "k")
            for r in rows]
    return spark.createDataFrame(full, schema)


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def odd_docs(rng: random.Random) -> list[tuple]:
    long_text = words(rng, 20_000)
    return [(1, None), (2, ""), (3, "  \t\n "), (4, "one"), (4, "one"), (5, "one"), (6, long_text), (7, long_text),
            (None, "alpha beta gamma delta eps zeta"), (None, None), (8, "x" * 300_000), (9, "é😀 ünï\u00a0code words here now")]
