"""Shingle sets, their fingerprints, and b-bit MinHash signatures, for whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import scan

K = 5
HASHES = 128
B_BITS = 16
_RNG = np.random.default_rng(424242)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def shingle_sets(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and each text's offset.

    A text of fewer than k words has one shingle, the whole sequence; without words it has none.
    """
    value, _, first = described_sets(column, k)
    return value, first


def described_sets(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets(), with a second hash of each shingle that does not depend on the first."""
    buf, offsets = scan.texts_of(column)
    buf = scan.LOWER[buf]
    starts, ends = scan.spans(buf, offsets, scan.NOT_SPACE)
    h, first = scan.digests(buf, starts, ends), np.searchsorted(starts, offsets)
    n = len(offsets) - 1
    count = np.diff(first)
    per = np.where(count >= k, count - k + 1, 0)
    at, text = scan.ranges(first[:-1], per), np.repeat(np.arange(n), per)
    value, other = (scan.windows(h[:, c], k)[at] for c in (0, 1))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.zeros((len(short), 2), np.uint64)
        for i in range(k - 1):  # the sequence, and its length, as one hash
            has = count[short] > i
            own[has] = own[has] * np.uint64(0x9E3779B97F4A7C15) + h[first[short[has]] + i]
        own = scan.mix(own + count[short].astype(np.uint64)[:, None])
        value, other, text = np.concatenate([value, own[:, 0]]), np.concatenate([other, own[:, 1]]), np.concatenate([text, short])
    order = np.argsort(value)
    order = order[np.argsort(text[order].astype(np.uint16) if n <= 1 << 16 else text[order], kind="stable")]
    value, other, text = value[order], other[order], text[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, other, text = value[keep], other[keep], text[keep]
    return value, other, np.searchsorted(text, np.arange(n + 1))


def fingerprints(value: np.ndarray, other: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits of each set, half of them from each hash of its shingles: equal sets, and in practice only these, have equal ones."""
    out = np.zeros((len(first) - 1, 2), np.uint64)
    for i, (own, salt) in enumerate(((value, 0x1B873593A5A5A5A5), (other, 0xCC9E2D51C3C3C3C3))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scan.mix(own ^ np.uint64(salt)))])
        out[:, i] = scan.mix(sums[first[1:]] - sums[first[:-1]] + np.uint64(i) + (first[1:] - first[:-1]).astype(np.uint64) * np.uint64(3))
    return out


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The low B_BITS of the HASHES minima of each set; sets must not be empty."""
    x = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, HASHES), np.uint16)
    y, z = np.empty_like(x), np.empty_like(x)
    for i in range(HASHES):
        np.bitwise_xor(x, _XOR[i], out=y)
        np.multiply(y, _MUL[i], out=y)
        np.right_shift(y, 15, out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, np.uint32(0x2C1B3C6D), out=y)
        low = np.minimum.reduceat(y, first[:-1]) if len(y) else np.zeros(0, np.uint32)
        out[:, i] = ((low ^ (low >> 16)) & 0xFFFF).astype(np.uint16)
    return out
