"""Vectorised word and shingle hashing over UTF-8 bytes, for use inside Arrow tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = [np.uint64(c) for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Odd multipliers for the positions of a shingle.
_AT = np.array([pow(_BASE, 3 + 2 * k, 1 << 64) for k in range(64)], np.uint64)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least of each."""
    while len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.uint64(pow(base, len(_powers[k]), 1 << 64))
            _powers[k] = np.concatenate([_powers[k], _powers[k] * step])
    return _powers


def texts(column: pa.Array):
    """The UTF-8 bytes of each value as an array; an empty one for null."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield data[offsets[k] : offsets[k + 1]] if valid[k] else data[:0]


def word_hashes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each maximal run without ASCII white space, A-Z as a-z."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64)
    out = np.ones(n + 2, bool)
    out[1:-1] = _IS_SPACE[data]
    edge = np.flatnonzero(out[1:] != out[:-1])
    starts, ends = edge[::2], edge[1::2]
    power, inverse = _powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data] if lower else data).astype(np.uint64) * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_set(data: np.ndarray, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of that many words; of all words as one run if there are fewer."""
    h = word_hashes(data)
    if not len(h):
        return h
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _AT[k]
    return np.unique(mix(total))


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name a shingle set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class OnePermutation:
    """One-permutation minwise signatures: a set's hashes fall into bins, each bin keeps its least; an
    empty bin borrows from the first filled one of its own random order (optimal densification)."""

    def __init__(self, bins: int = 128, rows: int = 4):
        assert bins & (bins - 1) == 0 and bins % rows == 0
        self.bins, self.rows, self.shift = bins, rows, np.uint64(64 - (bins.bit_length() - 1))
        self.order = np.stack([np.random.RandomState(k).permutation(bins) for k in range(bins)])
        self.edges = np.arange(bins, dtype=np.uint64) << self.shift
        self.band_salt = mix(np.arange(1, bins // rows + 1, dtype=np.uint64) * _AT[9])

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        first = np.searchsorted(hashes, self.edges)
        filled = np.append(first[1:], len(hashes)) > first
        if not filled.all():
            empty = np.flatnonzero(~filled)
            order = self.order[empty]
            first[empty] = first[order[np.arange(len(empty)), filled[order].argmax(1)]]
        return hashes[first]

    def bands(self, signature: np.ndarray) -> np.ndarray:
        parts = signature.reshape(-1, self.rows)
        total = self.band_salt.copy()
        for k in range(self.rows):
            total += mix(parts[:, k] + _AT[20]) * _AT[10 + k]
        return mix(total).view(np.int64)

    def sketch(self, signature: np.ndarray) -> np.ndarray:
        """One bit of each bin, packed into 64-bit integers."""
        return np.packbits(mix(signature) & np.uint64(1) != 0).view(np.int64)
