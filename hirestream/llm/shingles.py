"""Hashes of words, of runs of words and of their minima, over a block of documents.

Words are hashed to 128 bits; a run of ``n`` words is a polynomial in its words modulo
2^64, in two lanes with their own multipliers, so runs compare by 128 bits. All are
whole-block array operations.
"""
from __future__ import annotations

import numpy as np
import xxhash

# Odd multipliers of the two lanes and of the finishing mix (fixed values).
LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


class Block:
    """Words of many documents, end to end: ``start[d]:start[d] + n[d]`` are document d's."""

    def __init__(self, texts: list[str | None], lower: bool = False, keep_words: bool = False):
        first: dict[bytes, int] = {}
        ids, n = [], []
        self.words: list[list[bytes]] = []
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            w = (raw.lower() if lower else raw).split()  # bytes.lower() is for A-Z only
            ids.append(np.fromiter((first.setdefault(x, len(first)) for x in w), np.int64, len(w)))
            n.append(len(w))
            if keep_words:
                self.words.append(w)
        self.n = np.array(n, np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.id = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, first)), np.uint64).reshape(-1, 2)
        self.lanes = [mix(table[:, i])[self.id] if len(table) else np.zeros(0, np.uint64) for i in range(2)]
        self._powers: list = [None, None]
        self._sums: list = [None, None]

    def _prepared(self, lane: int):
        if self._sums[lane] is None:
            base = LANES[lane]
            n = len(self.id) + 1
            with np.errstate(over="ignore"):
                up = np.cumprod(np.full(n, base, np.uint64))
                down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
                self._sums[lane] = np.concatenate(([np.uint64(0)], np.cumsum(self.lanes[lane] * up[:-1])))
            self._powers[lane] = down
        return self._sums[lane], self._powers[lane]

    def runs(self, size: int, lane: int) -> np.ndarray:
        """Hash of the ``size`` words from every place on; places near a document's end
        run into the next document and are for the caller to leave out."""
        s, down = self._prepared(lane)
        n = len(self.id) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (s[size:size + n] - s[:n]) * down[:n]

    def places(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where a run of ``size`` words of one document starts, and its document."""
        fit = np.maximum(self.n - size + 1, 0)
        doc = np.repeat(np.arange(len(fit)), fit)
        at = np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit) + np.repeat(self.start, fit)
        return at, doc


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` neighbours."""
    if len(x) < size:
        return x[:0]
    m, have = x, 1
    while 2 * have <= size:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = size - have
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m
