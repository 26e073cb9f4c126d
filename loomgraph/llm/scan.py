"""Vectorised word and window scans over the bytes of many texts at once.

A batch of texts is one byte buffer with offsets.  Words, word hashes and window
hashes come from whole-buffer NumPy passes, so no Python code runs per word.
Hashes are 64-bit: a random table value per byte, summed with powers of an odd
multiplier, then mixed.  They do not depend on the position or the batch.  Long texts with equal sums can
be made on purpose, so such a hash only proposes equal strings: its users compare the bytes, or take
``distinct`` (which does) and ``digests`` instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes outside the six ASCII white-space characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: ASCII digits, lower-case ASCII letters, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int, kind: str = "up") -> np.ndarray:
    """multiplier ** 0 .. n-1 (kind "down": of its inverse), modulo 2**64."""
    if len(_powers[kind]) < n:
        full = np.full(max(n, 1 << 16), _MULT if kind == "up" else _INV, np.uint64)
        full[0] = 1
        _powers[kind] = np.multiply.accumulate(full)
    return _powers[kind][:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null counts as an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``most`` text bytes, and of one row at least, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def spans(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with inside[byte]; no run crosses an offset."""
    mask = inside[buf]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running sums by which substring() hashes any substring in constant time."""
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[buf] * powers(len(buf)), out=sums[1:])
    return sums


def substring(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), "down")[starts])


def words(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and for each text the index of its first word (one more at the end)."""
    starts, ends = spans(buf, offsets, inside)
    return starts, ends, substring(prefix_sums(buf), starts, ends), np.searchsorted(starts, offsets)


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct substring, and for each substring the number of its like; starts must rise, and
    substrings not overlap.  Equality is that of the bytes (of ``buf``, an array of any type)."""
    raw, width = np.ascontiguousarray(buf).view(np.uint8), buf.dtype.itemsize
    if len(starts) and (starts[1:] == ends[:-1]).all():
        own = _binary(raw, np.append(starts, ends[-1]) * width)
    else:  # with the gaps between them, they partition the buffer
        own = _binary(raw, np.append(np.stack([starts, ends], 1).ravel(), len(buf)) * width).take(pa.array(np.arange(0, 2 * len(starts), 2)))
    of = np.asarray(pc.dictionary_encode(own).indices).astype(np.int64)
    one = np.empty(int(of.max(initial=-1)) + 1, np.int64)
    one[of[::-1]] = np.arange(len(of))[::-1]
    return one, of


def _binary(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of each substring, as two columns: a cryptographic digest, computed once for each distinct one."""
    one, of = distinct(buf, starts, ends)
    raw = buf.tobytes()
    found = b"".join([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
    return np.frombuffer(found, np.uint64).reshape(-1, 2)[of]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words, whatever text they are in (the caller drops those that cross texts)."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= _MULT
        out += hashes[i : i + n]
    return mix(out)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (counts[0] of them), starts[1], ... in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)
