"""An exact table from words (bytes) to token ids, asked for many words at
once, and the cutting of texts into the parts whose ids are looked up.

A part of up to 24 bytes is three 64-bit numbers and a length, which are
compared as such, so no hash decides equality; longer parts, which are rare,
are keys of a dictionary."""

from __future__ import annotations

import numpy as np

from cardflow.llm.hashing import mix

SPACE, LETTER, MARK, OTHER = 0, 1, 2, 3
SHORT = 24
PAD = b" " + b"\0" * SHORT


def byte_classes(marks: bytes) -> np.ndarray:
    """Class of each byte: ASCII white space, ASCII letters, ``marks``, others."""
    out = np.full(256, OTHER, dtype=np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[[*range(65, 91), *range(97, 123)]] = LETTER
    out[list(marks)] = MARK
    return out


class Parts:
    """The parts of texts: a word of letters (ASCII and Latin-1, lower-cased
    here) with marks behind it or none is its letters and its marks; any
    other word is one part as it stands."""

    def __init__(self, texts: list[bytes], classes: np.ndarray):
        raw = np.frombuffer(b" " + b" ".join(texts) + PAD, dtype=np.uint8)
        length = np.array([len(t) for t in texts], dtype=np.int64) + 1
        kind = classes[raw]
        kind[-SHORT:] = SPACE
        low = raw.copy()
        capital = (raw >= 65) & (raw <= 90)
        low[capital] += 32
        lead = np.flatnonzero(raw[:-1] == 0xC3)  # a Latin-1 letter: this byte and the next
        if len(lead):
            second = raw[lead + 1]
            lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
            kind[lead] = kind[lead + 1] = LETTER
            up = lead[raw[lead + 1] <= 0x9E] + 1
            low[up] += 32
        # runs of one class; the first and the last are white space
        at = np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(raw)]))
        of = np.concatenate((kind[at[:-1]], [SPACE, SPACE]))
        blank = of == SPACE
        first = np.zeros(len(of), dtype=bool)
        first[1:] = blank[:-1] & ~blank[1:]
        first[-2:] = False
        n = len(at) - 1
        letters = first[:n] & (of[:n] == LETTER) & (blank[1:n + 1] | ((of[1:n + 1] == MARK) & blank[2:n + 2]))
        marks = np.zeros(n, dtype=bool)
        marks[1:] = letters[:-1] & (of[1:n] == MARK)
        odd = first[:n] & ~letters
        spaces = np.flatnonzero(blank[:n])
        mine = np.flatnonzero(letters | marks | odd)
        self.start = at[mine]
        self.end = at[mine + 1]
        self.plain = letters[mine]
        strange = np.flatnonzero(odd[mine])
        self.end[strange] = at[spaces[np.searchsorted(spaces, mine[strange])]]
        for i in strange.tolist():
            low[self.start[i]:self.end[i]] = raw[self.start[i]:self.end[i]]
        self.bytes = low.tobytes()
        #: For each text, the number of parts before its end.
        self.upto = np.searchsorted(self.start, np.cumsum(length) + 1)

    def __getitem__(self, i: int) -> bytes:
        return self.bytes[self.start[i]:self.end[i]]

    def numbers(self) -> np.ndarray:
        """Each part as three numbers of eight bytes (those beyond 24 left
        out) and its length."""
        buf = np.frombuffer(self.bytes, dtype=np.uint8)
        view = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
        n = self.end - self.start
        out = np.zeros((4, len(n)), dtype=np.uint64)
        out[3] = n
        for j in range(3):
            some = np.flatnonzero(n > 8 * j) if j else slice(None)
            rest = np.clip(n[some] - 8 * j, 0, 8)
            out[j, some] = view[self.start[some] + 8 * j] & MASK[rest]
        return out


MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


class WordTable:
    """Ids of parts, numbered as they come; ``clear`` forgets all."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.bits = 14
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = np.zeros((4, 0), dtype=np.uint64)
        self.begin, self.count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=self.kind)
        self.long: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.begin)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys[0] ^ (keys[1] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[2] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (keys[3] << np.uint64(59)))
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, parts: Parts, keys: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The numbers of the parts ``which``; -1 where one is not held."""
        out = np.full(len(which), -1, dtype=np.int64)
        length = keys[3][which]
        if len(self):
            left = np.flatnonzero(length <= SHORT)
            key = keys[:, which[left]]
            slot = self._slot(key)
            while len(left):
                word = self.slots[slot]
                same = (self.keys[0][word] == key[0]) & (self.keys[3][word] == key[3]) & (word >= 0)
                wide = np.flatnonzero(same & (key[3] > 8))
                same[wide] = (self.keys[1][word[wide]] == key[1, wide]) & (self.keys[2][word[wide]] == key[2, wide])
                out[left[same]] = word[same]
                on = np.flatnonzero(~same & (word >= 0))
                left, key, slot = left[on], key[:, on], (slot[on] + 1) & ((1 << self.bits) - 1)
        for i in np.flatnonzero(length > SHORT).tolist():
            out[i] = self.long.get(parts[which[i]], -1)
        return out

    def add(self, words: list[bytes], keys: np.ndarray, ids: list[bytes]) -> None:
        """Hold new words, all different, with their ids."""
        number = np.arange(len(words)) + len(self)
        count = np.array([len(i) for i in ids], dtype=np.int64) // self.kind.itemsize
        self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(ids), dtype=self.kind)))
        self.keys = np.concatenate((self.keys, keys), axis=1)
        short = keys[3] <= SHORT
        for i in np.flatnonzero(~short).tolist():
            self.long[words[i]] = int(number[i])
        if 2 * len(self) > 1 << self.bits:
            while 2 * len(self) > 1 << self.bits:
                self.bits += 2
            self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
            self._place(np.flatnonzero(self.keys[3] <= SHORT))
        else:
            self._place(number[short])

    def _place(self, number: np.ndarray) -> None:
        slot = self._slot(self.keys[:, number])
        while len(number):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = number[free]  # of several at one slot one stays
            rest = np.flatnonzero(self.slots[slot] != number)
            number, slot = number[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts one after another, and the number of ids
        before the end of each part."""
        count = self.count[number]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        return self.pool[np.repeat(self.begin[number] - (upto - count), count) + np.arange(total)], upto
