"""Vectorised word and shingle hashing over batches of texts (numpy, one pass over the UTF-8 bytes)."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.Generator(np.random.PCG64(20240601))
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_CODE[_WS] = 0
_BASE = np.uint64(int(_rng.integers(1, 2**62)) * 2 + 1)
_MUL = _rng.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_weight = np.ones(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-multiply), so that every bit depends on all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(n: int) -> np.ndarray:
    """A pseudorandom odd number for each place in a word. Powers of one base would make words collide that are built to (those of
    Thue and Morse), whatever the base."""
    global _weight
    if len(_weight) < n:
        _weight = mix64(np.arange(max(2 * n, 4096), dtype=np.uint64) * _BASE + _BASE) | np.uint64(1)
    return _weight


class Words:
    """Words of a batch: byte ranges, 64-bit hashes, and offsets of each text's first word (n + 1 entries)."""

    def __init__(self, texts: list, lower: bool = True):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        joined = b"\n".join(raw) + b"\n"
        if lower:
            joined = joined.translate(_LOWER)
        self.bytes = buf = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        self.text_start = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        ws = _WS[buf]
        edge = np.flatnonzero(np.diff(ws, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        if len(self.start):
            length = np.diff(np.append(self.start, len(buf)))
            first = self.start[0]
            rel = np.arange(first, len(buf)) - np.repeat(self.start, length)
            self.hash = mix64(np.add.reduceat(_CODE[buf[first:]] * _weights(int(rel.max()) + 1)[rel], self.start - first) + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)
        self.offset = np.searchsorted(self.start, np.concatenate([self.text_start, [len(buf)]]))

    def shingles(self, i: int, k: int) -> np.ndarray:
        """Sorted distinct hashes of text i's k-word shingles; the whole sequence where it has fewer words; empty without words."""
        return shingle_set(self.hash[self.offset[i] : self.offset[i + 1]], k)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of a word-hash sequence, in order."""
    n = len(h)
    if not n:
        return h
    k2 = min(k, n)
    out = h[: n - k2 + 1] * _MUL[0]
    for j in range(1, k2):
        out = out + h[j : n - k2 + 1 + j] * _MUL[j]
    return mix64(out + np.uint64(k2))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(h, k))


def batches(texts: list, max_chars: int = 250_000):
    """Slices (lo, hi) of texts with about max_chars characters each; one long text may exceed it alone. Words takes some forty
    bytes a byte of text for a while."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > max_chars:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
