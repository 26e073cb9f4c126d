"""A run-compressed Burrows-Wheeler index with sampled run ends, and matching statistics.

The index holds short texts ("segments"), each ended by a mark that no UTF-8 text contains and that
counts as different for every segment.  Kept are the runs of the transform (character, first
row, image of that row under the LF mapping), the text positions at both ends of each run, and for
each block of rows that agree on ``depth`` bytes the least label among them: all of these follow the number of
runs or blocks.  The segments' bytes are kept as they are, a byte each, to compare matches.  While it is built, the
index needs about 60 bytes a byte of text (ranks and rows of all suffixes).  Queries are streamed from their right ends, all together, one byte a round: inside a run
of its byte a query follows LF; elsewhere it jumps to the nearest run of its byte above or below,
whichever end agrees longer with the current match, and goes on from there.
"""

from __future__ import annotations

import numpy as np

MARK = 0xFF


def packed(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as big-endian numbers (zeros after the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def suffix_ranks(text: np.ndarray, to_mark: np.ndarray) -> np.ndarray:
    """Rank of every suffix; to_mark: bytes until the segment's mark.  By doubling; settled suffixes are left out."""
    n = len(text)
    key = packed(text)
    cut = np.minimum(to_mark, 7).astype(np.uint64)  # nothing after the mark counts
    key >>= (np.uint64(7) - cut) * np.uint64(8)
    key <<= (np.uint64(7) - cut) * np.uint64(8)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]

    def refine(open_: np.ndarray, second: np.ndarray) -> None:
        both = (rank[open_].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        o = np.argsort(both)
        at, b = open_[o], both[o]
        group = np.r_[True, (b[1:] >> np.uint64(32)) != (b[:-1] >> np.uint64(32))]
        part = np.r_[True, b[1:] != b[:-1]]
        place = np.arange(len(b))
        rank[at] += np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))

    ended = np.flatnonzero(to_mark < 8)
    if len(ended):
        refine(ended, ended)  # equal up to the mark: by segment, that is by place
    size = np.bincount(rank, minlength=n)
    left, h = np.flatnonzero(size[rank] > 1), 8
    while len(left):
        refine(left, rank[left + h])  # the mark is further away than h
        size = np.bincount(rank[left], minlength=n)
        left, h = left[size[rank[left]] > 1], 2 * h
    return rank


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, the first in the lowest byte (zeros after the end), as a view of the text: no memory of its own."""
    return np.ndarray((len(text),), "<u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))


class RunIndex:
    def __init__(self, text: np.ndarray, lengths: np.ndarray, labels: np.ndarray, depth: int) -> None:
        """``text``: the segments, one after the other; ``labels``: one number for each."""
        n_seg = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        self.text = np.full(len(text) + n_seg, MARK, np.uint8)
        inside = np.ones(len(self.text), bool)
        inside[ends] = False
        self.text[inside] = text
        segment = np.repeat(np.arange(n_seg), lengths + 1)
        to_mark = ends[segment] - np.arange(len(self.text))
        rank = suffix_ranks(self.text, to_mark)
        n = len(rank)
        rows = np.empty(n, np.int64)
        rows[rank] = np.arange(n)
        bwt = self.text[rows - 1]
        start = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.start, self.char = start, bwt[start].astype(np.int64)
        size = np.diff(np.r_[start, n])
        self.last = start + size - 1
        self.first_at, self.last_at = rows[start], rows[self.last]
        # LF of a run's first row: suffixes with smaller first bytes, then earlier runs of the same byte
        by = np.argsort(self.char, kind="stable")
        before = np.empty(len(start), np.int64)
        before[by] = np.cumsum(size[by]) - size[by]
        self.image = before  # the runs of each byte stand together, bytes in order: the sums are C and rank at once
        self.by_char = self.char[by] * len(start) + by
        self.words = words_at(self.text)
        # blocks of rows that agree on depth bytes within their segments
        long = to_mark[rows] >= depth
        same = long[1:] & long[:-1] & self._agree(rows[1:], rows[:-1], depth)
        block = np.flatnonzero(np.r_[True, ~same])
        self.block = block
        self.least = np.minimum.reduceat(labels[segment[rows]], block)

    def _agree(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        ok = np.ones(len(a), bool)
        for k in range(0, depth, 8):
            at = np.flatnonzero(ok)
            diff = self.words[np.minimum(a[at] + k, len(self.words) - 1)] ^ self.words[np.minimum(b[at] + k, len(self.words) - 1)]
            rest = min(8, depth - k)
            ok[at] = (diff << np.uint64(8 * (8 - rest))) == 0
        return ok

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common, ``most`` at most."""
        out = np.zeros(len(a), np.int64)
        at = np.flatnonzero(most > 0)
        while len(at):
            k = out[at]
            x, y = a[at] + k, b[at] + k
            inside = (x < len(self.words)) & (y < len(self.words))
            diff = self.words[np.minimum(x, len(self.words) - 1)] ^ self.words[np.minimum(y, len(self.words) - 1)]
            equal = np.zeros(len(at), np.int64)
            for s in range(8):
                equal += (diff << np.uint64(8 * (7 - s))) == 0
            out[at] = np.where(inside, np.minimum(k + equal, most[at]), k)
            at = at[inside & (equal == 8) & (out[at] < most[at])]
        return out

    def statistics(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For query places where a match of ``depth`` bytes or more starts: the query, the place in it, the least label."""
        order = np.argsort(-lengths, kind="stable")
        ends, lengths = (starts + lengths)[order], lengths[order]
        row, at, size = np.zeros(len(order), np.int64), np.full(len(order), self.first_at[0]), np.zeros(len(order), np.int64)
        found = []
        runs = len(self.start)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-lengths, -(t + 1), "right"))
            c = text[ends[:n] - 1 - t].astype(np.int64)
            run = np.searchsorted(self.start, row[:n], "right") - 1
            odd = np.flatnonzero(self.char[run] != c)
            if len(odd):
                want = c[odd] * runs + run[odd]
                i = np.searchsorted(self.by_char, want)
                down_key, up_key = self.by_char[np.minimum(i, runs - 1)], self.by_char[np.maximum(i - 1, 0)]
                has_down = (i < runs) & (down_key // runs == c[odd])
                has_up = (i > 0) & (up_key // runs == c[odd])
                down, up = np.where(has_down, down_key % runs, 0), np.where(has_up, up_key % runs, 0)
                most = size[odd]
                lce_down = np.where(has_down, self.common(at[odd], self.first_at[down], np.where(has_down, most, 0)), -1)
                lce_up = np.where(has_up, self.common(at[odd], self.last_at[up], np.where(has_up, most, 0)), -1)
                best = np.maximum(lce_down, lce_up)
                go_up = lce_up >= lce_down
                ok = best >= 0
                new = np.where(go_up, up, down)
                run[odd] = np.where(ok, new, run[odd])
                row[odd] = np.where(ok, np.where(go_up, self.last[new], self.start[new]), row[odd])
                at[odd] = np.where(ok, np.where(go_up, self.last_at[new], self.first_at[new]), at[odd])
                size[odd] = np.where(ok, best, -1)  # -1: the byte is nowhere in the index
                stay = odd[~ok]
            else:
                stay = odd
            step = np.ones(n, bool)
            step[stay] = False
            moved = self.image[run] + row[:n] - self.start[run]
            row[:n] = np.where(step, moved, row[:n])
            at[:n] = np.where(step, at[:n] - 1, at[:n])
            size[:n] += 1
            hit = np.flatnonzero(size[:n] >= depth)
            if len(hit):
                label = self.least[np.searchsorted(self.block, row[hit], "right") - 1]
                found.append((order[hit], lengths[hit] - 1 - t, label))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
