"""Vectorised word-shingle sets over UTF-8 bytes.

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D`` after folding A-Z to a-z, so a
whole batch of texts is split, hashed and combined with a handful of NumPy passes and no
per-word Python object.  A shingle is represented by a 64-bit hash; two different shingles
collide with a probability of about 2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text handled at once; bounds the scratch arrays.
CHUNK_BYTES = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 1024), _BASE | 1, np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, hash) of every word of a byte array."""
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    ends = np.flatnonzero(edge == -1)
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    sizes = ends - starts
    value = _BYTE[_FOLD[data]]
    first = np.zeros(len(data), np.int32)
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    at = np.arange(len(data), dtype=np.int32) - first
    at[~inside] = 0
    value *= _powers(int(sizes.max()) + 1)[at]
    value[~inside] = 0
    return starts, _mix(np.add.reduceat(value, starts) + sizes.astype(np.uint64))


def _combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words."""
    n = len(h) - k + 1
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(_BASE)
        out ^= out >> np.uint64(29)
        out += h[i : i + n]
    return _mix(out)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer words has its whole sequence as one shingle; null, empty and blank texts
    have the empty set.
    """
    out: list[np.ndarray] = []
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    i = 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) < CHUNK_BYTES):
            size += len(raw[j]) + 1
            j += 1
        data = np.frombuffer(b" ".join(raw[i:j]), np.uint8)
        starts, h = word_hashes(data)
        limits = np.cumsum([0, *(len(x) + 1 for x in raw[i:j])])
        cut = np.searchsorted(starts, limits)
        grams = _combine(h, words) if len(h) >= words else h[:0]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= words:
                s = np.sort(grams[a : b - words + 1])
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif b > a:
                out.append(_combine(h[a:b] ^ np.uint64(b - a), b - a))
            else:
                out.append(np.zeros(0, np.uint64))
        i = j
    return out


def set_digest(s: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
