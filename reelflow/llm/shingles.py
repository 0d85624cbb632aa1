"""Shingle sets of texts as sorted 64-bit hashes, in numpy, many texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5

_ODD = np.array([xxhash.xxh3_64_intdigest(b"shingle %d" % i) | 1 for i in range(SHINGLE + 1)], np.uint64)
_BASE = xxhash.xxh3_64_intdigest(b"base") | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A random value per byte; A-Z share those of a-z. White space ends a word.
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower(), 7) for b in range(256)], np.uint64)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, number of words of each text)."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    up, down = _powers_to(len(data))
    blank = _BLANK[data]
    total = _VALUE[data]
    total *= up[: len(data)]
    np.cumsum(total, out=total)
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    first, last = edge[0::2] + 1, edge[1::2]
    h = (total[last] - total[first - 1]) * down[first]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(first, ends, "right")
    return mix(h), np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each text's distinct shingles in rising order, one text after the other.

    A text of one to four words has its whole sequence as one shingle; one without words has none.
    """
    w, counts = word_hashes(texts)
    starts = np.concatenate(([0], np.cumsum(counts)))
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(n)))
    padded = np.concatenate((w, np.zeros(SHINGLE, np.uint64)))
    place = np.repeat(starts[:-1], n) + np.arange(at[-1]) - np.repeat(at[:-1], n)
    out = padded[place] * _ODD[0]
    for j in range(1, SHINGLE):
        out += padded[place + j] * _ODD[j]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        c = counts[i]
        out[at[i]] = np.sum(w[starts[i] : starts[i] + c] * _ODD[:c]) ^ (_ODD[SHINGLE] << np.uint64(c))
    mix(out)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    some = n > 0
    fresh[at[:-1][some]] = True
    if some.any():
        n[some] = np.add.reduceat(fresh.astype(np.int64), at[:-1][some])
    return out[fresh], n
