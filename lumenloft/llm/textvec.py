"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

A word's hash is a difference of prefix sums of byte * B ** place (mod 2 ** 64), shifted back to place 0 by the inverse
power and mixed, so no step runs word by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, INVERSE)):
            a = np.full(max(n, 1 << 16), base, U)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """buf: all bytes; off: where each text starts (one more at the end); start, stop: byte places of each word; of: its text."""

    def __init__(self, column: pa.Array):
        self._hashes = None
        column = pc.fill_null(column.cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        inside = ~SPACE[self.buf]
        first = np.zeros(len(self.buf) + 1, bool)
        first[self.off] = True
        first = first[:-1]
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        self.start = np.flatnonzero(inside & (~before | first))
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        last = np.concatenate([first[1:], [True]]) if len(inside) else inside
        self.stop = np.flatnonzero(inside & (~after | last)) + 1
        self.of = np.searchsorted(self.off, self.start, side="right") - 1
        self.counts = np.bincount(self.of, minlength=len(column)).astype(np.int64)

    def hashes(self, lower: bool = True) -> np.ndarray:
        if self._hashes is not None and self._hashes[0] == lower:
            return self._hashes[1]
        if not len(self.start):
            return np.zeros(0, U)
        up, down = powers(len(self.buf) + 1)
        b = (LOWER[self.buf] if lower else self.buf).astype(U) + U(1)
        total = np.concatenate([np.zeros(1, U), np.cumsum(b * up[: len(b)], dtype=U)])
        h = (total[self.stop] - total[self.start]) * down[self.start]
        self._hashes = lower, mix(h ^ ((self.stop - self.start).astype(U) * U(0xD6E8FEB86659FD93)))
        return self._hashes[1]

    def shingles(self, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every run of k words; a text with 1 to k - 1 words gives its whole sequence once."""
        w = self.hashes(lower)
        n = len(w)
        if not n:
            return np.zeros(0, U), np.zeros(0, np.int64)
        h = np.zeros(max(n - k + 1, 0), U)
        for i in range(k):
            h = mix(h * U(0x2545F4914F6CDD1D) + w[i : n - k + 1 + i] + U(i + 1)) if len(h) else h
        whole = np.flatnonzero(self.of[: len(h)] == self.of[k - 1 :]) if len(h) else np.zeros(0, np.int64)
        at = np.searchsorted(self.of, np.arange(len(self.counts)))
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        g = np.zeros(len(short), U)
        for i in range(k - 1):
            has = self.counts[short] > i
            g = np.where(has, mix(g * U(0x2545F4914F6CDD1D) + w[np.minimum(at[short] + i, n - 1)] + U(i + 1)), g)
        g = mix(g + self.counts[short].astype(U) * U(0xA0761D6478BD642F))
        return np.concatenate([h[whole], g]), np.concatenate([self.of[whole], short])

    def sets(self, k: int, lower: bool = True) -> list[np.ndarray]:
        """Each text's distinct shingles in order of hash."""
        h, of = self.shingles(k, lower)
        short = np.flatnonzero(of[1:] < of[:-1])  # the short texts' hashes come last
        body = len(h) if not len(short) else int(short[0]) + 1
        cut = np.searchsorted(of[:body], np.arange(len(self.counts) + 1)).tolist()
        out = [h[:0]] * len(self.counts)
        for i in range(len(out)):
            if cut[i + 1] > cut[i]:
                part = np.sort(h[cut[i] : cut[i + 1]])
                out[i] = part[np.concatenate([[True], part[1:] != part[:-1]])]
        for i, v in zip(of[body:].tolist(), h[body:], strict=True):
            out[i] = np.array([v], U)
        return out

    def distinct(self, k: int, lower: bool = True) -> np.ndarray:
        """How many distinct shingles each text has, by 44 bits of their hashes: for statistics only."""
        h, of = self.shingles(k, lower)
        key = np.sort(of.astype(U) << U(44) | h >> U(20))
        keep = np.ones(len(key), bool)
        keep[1:] = key[1:] != key[:-1]
        return np.bincount((key[keep] >> U(44)).astype(np.int64), minlength=len(self.counts))
