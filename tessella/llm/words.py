"""Words of joined texts as arrays of byte positions and hashes."""

from __future__ import annotations

import numpy as np

from tessella.llm.common import SpanHash

#: Each byte lower-cased if it is part of a word (digits, letters, bytes of non-ASCII signs), else 0.
WORD_BYTE = np.array([b + 32 * (65 <= b <= 90) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


class Words:
    """Words of joined texts; text t has the words first[t] to first[t + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> None:
        n = len(data)
        self.lower = WORD_BYTE[data]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = self.lower != 0
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        here, before = inside[1:], inside[:-1]  # of the border at each place
        self.start = np.flatnonzero(here[:n] & (~before[:n] | cut[:n]))
        self.end = np.flatnonzero(before & (~here | cut))
        self.first = np.searchsorted(self.start, offsets)
        self.hash = hasher.of(hasher.totals(self.lower), self.start, self.end)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def shingles(self, size: int) -> np.ndarray:
        """A hash of the size words from each word on (rows near the end of all words are left out)."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += self.hash[i : i + n]
        out ^= out >> np.uint64(31)
        return out * np.uint64(0x9E3779B97F4A7C15)

    def within(self, size: int) -> np.ndarray:
        """Whether the size words from each word on are of one text."""
        n = max(0, len(self.hash) - size + 1)
        return self.text[:n] == self.text[size - 1 : size - 1 + n]

    def joined(self, a: int, b: int) -> bytes:
        return b" ".join(self.lower[x:y].tobytes() for x, y in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True))
