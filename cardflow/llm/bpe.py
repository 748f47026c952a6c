"""Byte-pair merging of many words at once, by a public tokenizer's own
vocabulary and merges.

The library merges one word at a time; here all words of a length are rows of
a matrix and every step merges, in each row, the pair of the lowest rank (the
first one of several).  The ids are the library's; the tests compare them.
Only for plain byte-level files with a word-end suffix; the caller leaves
everything else to the library."""

from __future__ import annotations

import json

import numpy as np

LONGEST = 40
ROWS = 1 << 14
NONE = np.uint32(0xFFFFFFFF)


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary:
    itself where it prints, else the next one from 256 up."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else spare))
        spare += b not in shown
    return out


class Merger:
    """Ids of words (bytes) after all merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix")
        chars = byte_characters()
        self.usable = (model.get("type") == "BPE" and bool(suffix) and not model.get("ignore_merges")
                       and not model.get("continuing_subword_prefix") and not model.get("dropout")
                       and max(vocab.values()) < 1 << 16 and all(c in vocab and c + suffix in vocab for c in chars))
        if not self.usable:
            return
        self.inner = np.array([vocab[c] for c in chars], dtype=np.uint32)
        self.final = np.array([vocab[c + suffix] for c in chars], dtype=np.uint32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.uint32)
        # an open table with linear probing: rank of a pair, by a product hash
        self.bits = 18
        self.keys = np.full(1 << self.bits, NONE)
        self.ranks = np.full(1 << self.bits, NONE)
        left, slot, self.probes = np.arange(len(key)), self._slot(key), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] == NONE
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ranks[slot[put]] = key[left[put]], left[put]
            rest = np.setdiff1d(np.arange(len(left)), put)
            left, slot = left[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE if it does not merge."""
        key = a << np.uint32(16) | b
        slot = self._slot(key)
        out = np.full(len(key), NONE)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (found != NONE)
            if not on.any():
                break
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _rows(self, sym: np.ndarray) -> list[bytes]:
        """Merge rows of equal length; every row ends with a word end."""
        n, width = sym.shape
        out: list = [None] * n
        rows = np.arange(n)
        ranks = self.rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width - 1)
        while width > 1:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                for r, s in zip(rows[done].tolist(), sym[done].astype("<u2")):
                    out[r] = s.tobytes()
                sym, ranks, rows, at, best = (x[~done] for x in (sym, ranks, rows, at, best))
                if not len(rows):
                    return out
            i = np.arange(len(rows))
            sym[i, at] = self.merged[best]
            # close the gap in each row
            place = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            sym = np.take_along_axis(sym, place, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(place[:, :-1], width - 2), axis=1) if width > 2 else ranks[:, :0]
            width -= 1
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 1)
            ranks[before, at[before] - 1] = self.rank(sym[before, at[before] - 1], sym[before, at[before]])
            ranks[after, at[after]] = self.rank(sym[after, at[after]], sym[after, at[after] + 1])
        for r, s in zip(rows.tolist(), sym.astype("<u2")):
            out[r] = s.tobytes()
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids (two bytes each) of words of 1 to LONGEST bytes."""
        length = np.array([len(w) for w in words])
        out: list = [None] * len(words)
        for n in np.unique(length):
            of = np.flatnonzero(length == n)
            for at in range(0, len(of), ROWS):
                part = of[at:at + ROWS].tolist()
                raw = np.frombuffer(b"".join([words[i] for i in part]), dtype=np.uint8).reshape(-1, n)
                sym = self.inner[raw]
                sym[:, -1] = self.final[raw[:, -1]]
                for i, ids in zip(part, self._rows(sym)):
                    out[i] = ids
        return out
