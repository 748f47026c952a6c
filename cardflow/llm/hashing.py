"""Vectorised hashing of the words of many texts, for use inside tasks."""

from __future__ import annotations

import ctypes
import re
import sys
from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
BASE = 0x9E3779B97F4A7C15
BUFFER = 1 << 21  # bytes hashed together


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base % 2**64, dtype=np.uint64)
    if n:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    return p


def pieces(texts: list[bytes], limit: int = BUFFER) -> Iterator[tuple[int, bytes]]:
    """Texts cut at white space into pieces of about ``limit`` bytes: the
    text's number and the piece.  A word is never cut."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > limit:
            m = _SPACE.search(t, at + limit)
            if m is None:
                break
            yield i, t[at:m.start()]
            at = m.start()
        yield i, t[at:] if at else t


def buffers(texts: list[bytes], limit: int = BUFFER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces joined by spaces into buffers of about ``limit`` bytes.  Gives
    the bytes (a space first and after each piece), and for each piece its
    text's number and its length with the space after it."""
    group: list[tuple[int, bytes]] = []
    size = 0

    def joined():
        buf = np.frombuffer(b" " + b" ".join(p for _, p in group) + b" ", dtype=np.uint8)
        return (buf, np.array([i for i, _ in group], dtype=np.int64),
                np.array([len(p) + 1 for _, p in group], dtype=np.int64))

    for i, p in pieces(texts, limit):
        if group and size + len(p) > limit:
            yield joined()
            group, size = [], 0
        group.append((i, p))
        size += len(p) + 1
    if group:
        yield joined()


def kept_by_worker() -> dict:
    """What this Python worker keeps between tasks (tokenizers with what they
    have learned)."""
    return sys.__dict__.setdefault("cardflow_kept", {})


def trim() -> None:
    """Give the memory that earlier tasks of this worker freed back to the
    system (the allocator keeps it otherwise); nothing where it cannot."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class WordHasher:
    """64-bit hashes of the words (runs of bytes other than white space)."""

    def __init__(self):
        kept_by_worker().clear()  # a stage that hashes words needs the memory, and no tokenizer
        trim()
        self.up = powers(BASE, 0)
        self.down = self.up

    def _tables(self, n: int):
        if len(self.up) < n:
            n = max(n, BUFFER + (BUFFER >> 2))
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 2**64), n)
        return self.up, self.down

    def spans(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end of every word of a buffer that begins and ends
        with white space."""
        space = SPACE[buf].view(np.int8)
        edge = np.diff(space)
        start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        up, down = self._tables(len(buf))
        total = np.empty(len(buf) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=total[1:])
        return mix((total[end] - total[start]) * down[start]), start, end

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words in order, and the number of words of each text."""
        found, counts = [], np.zeros(len(texts), dtype=np.int64)
        for buf, text, length in buffers(texts):
            h, start, _ = self.spans(buf)
            found.append(h)
            piece = np.searchsorted(1 + np.cumsum(length), start, side="right")
            np.add.at(counts, text, np.bincount(piece, minlength=len(text)))
        return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def encode(texts) -> list[bytes]:
    """UTF-8 of a column of texts; null: empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
