"""Removal of byte strings of LENGTH bytes or more that also occur in a document with a smaller key.

The corpus is dealt into shards by a hash of the key, and every window of LENGTH bytes gets the
smallest hash of the K-byte strings in it, its anchor; equal windows have equal anchors, and
neighbouring windows mostly share one, so they form short segments.

1. Each shard sends the distinct anchors it holds (6 bytes each) to buckets by anchor, with a mark
   on those that several of its documents hold, and on those that MANY different segments of it have.
   A bucket answers, two bits for each, which anchors more than one document holds, and which of
   them are hot: held by very many shards, or with many segments in one.  All other windows occur once.
2. Each shard sends its distinct segments of shared anchors to the buckets, with the smallest and
   largest key that holds them.  The segments of hot anchors are cut into their windows, which are dealt by
   their own hashes, so that what is common to very many documents, with different text around it, is spread
   over all buckets.  Equal segments become one.  An anchor with several different
   segments needs the index: per bucket a run-length compressed Burrows-Wheeler transform
   with sampled run ends (run_index.py) over all its segments but the one that starts
   last, through which all of them are streamed.  The matching statistics give every window
   of LENGTH bytes or more that stands in the index, and with it the smallest key.
3. The shards get, for each segment, its windows' smallest keys, and mark what to remove.

All three steps read one shuffle of the texts (the exchange is reused).  A window that very many
documents share is one row for each shard, whatever their number; an anchor of a bucket has at most
4096 shards (with SHARD_BYTES; in proportion else) with fewer than MANY segments each, or those of one
shard.  So no task gathers a group.  (Lower limits cost traffic: with 64 shards common phrases of 0.5 GB already send 1.7 times
the bytes, since a window has LENGTH bytes of its own.)
A shard and a bucket have SHARD_BYTES of text each; from 32 GB on they grow with the square root of the
corpus, up to MOST_SHARD_BYTES, so that what a shard has for a bucket does not become a few bytes.

Defined cases: a null or empty text has no bytes and nothing to remove; texts of fewer than LENGTH
bytes lose nothing; rows with one key are one document, whose texts do not remove each
other's strings; a row with a null key is neither searched nor a source; repeated rows have equal
results; an empty table gives an empty result; other columns are ignored, whatever their names.  Very long texts
are worked on as pieces of their own: memory is about 100 bytes a byte of the longest text.  Ties do not
arise: of equal strings those of the smallest key stay, all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .run_index import RunIndex
from ..shipping import ship

LENGTH = 50
K = 20
SHARD_BYTES = 4 << 20
MOST_SHARD_BYTES = 128 << 20
#: Text bytes that a shard has for a bucket, at least, as long as shards may grow.
PAIR_BYTES = 512
LEAST_SHARDS = 64
#: Different segments of one anchor in one shard from which on the anchor is hot, if other shards have it too.
MANY = 256
MOST_WINDOWS = 64
NONE = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    k, m = 1, x
    while 2 * k <= width:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    return np.minimum(m[: len(m) - (width - k)], m[width - k :]) if width > k else m


@dataclass
class Segments:
    """Maximal runs of windows with one anchor, of MOST_WINDOWS at most, in text order."""

    text: np.ndarray  # row of the text
    start: np.ndarray  # first byte, in the buffer
    windows: np.ndarray  # number of windows; the segment has windows + LENGTH - 1 bytes
    anchor: np.ndarray
    content: np.ndarray  # hash of the bytes


def segments(buf: np.ndarray, offsets: np.ndarray) -> Segments:
    size = np.diff(offsets)
    if len(buf) < LENGTH or not (size >= LENGTH).any():
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    sums = scan.prefix_sums(buf)
    n = len(buf) - K + 1
    low = sliding_min(scan.mix((sums[K:] - sums[:-K]) * scan.powers(len(sums), "down")[:n]), LENGTH - K + 1)
    valid = np.zeros(len(low) + 1, np.int64)  # windows that end within their text
    own = size >= LENGTH
    np.add.at(valid, offsets[:-1][own], 1)
    np.add.at(valid, offsets[1:][own] - LENGTH + 1, -1)
    inside = np.cumsum(valid[:-1]) > 0
    new = inside.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    new[offsets[:-1][own]] = True
    start = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True])
    windows = last - start + 1
    parts = -(-windows // MOST_WINDOWS)
    if len(parts) and parts.max() > 1:
        ends = np.repeat(start + windows, parts)
        start = np.repeat(start, parts) + MOST_WINDOWS * scan.ranges(np.zeros(len(parts), np.int64), parts)
        windows = np.minimum(MOST_WINDOWS, ends - start)
    return Segments(np.searchsorted(offsets, start, "right") - 1, start, windows, low[start], scan.substring(sums, start, start + windows + LENGTH - 1))


def _pieces(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, whether each is there, bytes and offsets of the texts of a shard, in pieces of bounded size."""
    for b in scan.pieces_of(iter(table.to_batches()), "t"):
        key = b.column("d")
        buf, offsets = scan.texts_of(b.column("t"))
        yield np.asarray(key.fill_null(0)), np.asarray(key.is_valid()), buf, offsets


def _keyed(keys: np.ndarray, there: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> tuple[Segments, np.ndarray]:
    """The segments of the texts that have a key, and the key of each."""
    s = segments(buf, offsets)
    ok = there[s.text]
    s = Segments(*(x[ok] for x in (s.text, s.start, s.windows, s.anchor, s.content)))
    return s, keys[s.text]


def _by_bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (anchor % np.uint64(buckets)).astype(np.int64)


@dataclass
class Anchors:
    """The distinct anchors of a shard, by bucket and anchor."""

    bucket: np.ndarray
    anchor: np.ndarray
    several: np.ndarray  # whether several keys hold it
    many: np.ndarray  # whether MANY different segments have it


def _distinct_anchors(anchor: np.ndarray, key: np.ndarray, content: np.ndarray, buckets: int) -> Anchors:
    order = np.argsort(anchor)
    anchor, key, content = anchor[order], key[order], content[order]
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start) if len(start) else np.zeros(0, bool)
    size, many = np.diff(np.append(start, len(anchor))), np.zeros(len(start), bool)
    for k in np.flatnonzero(size >= MANY):
        many[k] = len(np.unique(content[start[k] : start[k] + size[k]])) >= MANY
    anchor = anchor[start]
    bucket = _by_bucket(anchor, buckets)
    order = np.argsort(bucket, kind="stable")
    return Anchors(bucket[order], anchor[order], several[order], many[order])


def _cuts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(bucket):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return start, np.r_[start[1:], len(bucket)]


def _short(x: np.ndarray) -> bytes:
    """The upper 6 bytes of 64-bit values."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _bits(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    return pa.array([np.packbits(x[s:e]).tobytes() for s, e in zip(start, end, strict=True)], pa.binary())


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n)


def _anchors(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        found = [_keyed(*piece) for piece in _pieces(table)]
        all_of = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        own = _distinct_anchors(all_of([s.anchor for s, _ in found], np.uint64), all_of([k for _, k in found], np.int64), all_of([s.content for s, _ in found], np.uint64), buckets)
        start, end = _cuts(own.bucket)
        return pa.table(
            {
                "bucket": pa.array(own.bucket[start], pa.int64()),
                "shard": pa.array(np.full(len(start), table["shard"][0].as_py()), pa.int64()),
                "h": pa.array([_short(own.anchor[s:e]) for s, e in zip(start, end, strict=True)], pa.binary()),
                "several": _bits(own.several, start, end),
                "many": _bits(own.many, start, end),
            }
        )

    return run


def _shared(hot_shards: int) -> Callable[[pa.Table], pa.Table]:
    """For each shard's anchors of a bucket: a bit for those that several documents hold, and one for the hot ones."""

    def run(table: pa.Table) -> pa.Table:
        raw = table["h"].to_pylist()
        size = np.array([len(x) // 6 for x in raw])
        whole = np.zeros((int(size.sum()), 8), np.uint8)
        whole[:, :6] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 6)
        several, many = (np.concatenate([_unpacked(m, n) for m, n in zip(table[c].to_pylist(), size, strict=True)]).astype(np.int64) for c in ("several", "many"))
        _, of = np.unique(whole.view("<u8").ravel(), return_inverse=True)
        shards = np.bincount(of)
        shared = shards + np.bincount(of, several) > 1
        hot = (shards > hot_shards) | ((shards > 1) & (np.bincount(of, many) > 0))
        end = np.cumsum(size)
        return pa.table({"shard": table["shard"], "bucket": table["bucket"], "bits": _bits(shared[of], end - size, end), "hot": _bits(hot[of], end - size, end)})

    return run


def _send(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The distinct segments with shared anchors, by bucket; of hot anchors the distinct windows."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = [(p[2], *_keyed(*p)) for p in _pieces(texts)] if texts.num_rows else []
        if not pieces:
            return _sent([], [], [], [], [], 0)
        anchor, key, content, windows, place = (np.concatenate(x) for x in zip(*[(s.anchor, k, s.content, s.windows, s.start) for _, s, k in pieces], strict=True))
        piece = np.repeat(np.arange(len(pieces)), [len(s.start) for _, s, _ in pieces])
        own = _distinct_anchors(anchor, key, content, buckets)
        start, end = _cuts(own.bucket)
        shared, hot = np.zeros(len(own.anchor), bool), np.zeros(len(own.anchor), bool)
        given = {b: (x, y) for b, x, y in zip(*(answers[c].to_pylist() for c in ("bucket", "bits", "hot")), strict=True)}
        for s, e in zip(start, end, strict=True):
            shared[s:e], hot[s:e] = (_unpacked(x, e - s) for x in given[int(own.bucket[s])])
        within = lambda chosen: np.isin(anchor, chosen)
        take = np.flatnonzero(within(own.anchor[shared & ~hot]))
        deal = anchor[take]
        anchor_hot = own.anchor[shared & hot]
        rows = [x[take] for x in (key, content, windows, place, piece)]
        cut = np.flatnonzero(within(anchor_hot)) if len(anchor_hot) else anchor_hot
        if len(cut):
            at = np.repeat(cut, windows[cut])
            begin = place[at] + scan.ranges(np.zeros(len(cut), np.int64), windows[cut])
            value = np.empty(len(at), np.uint64)
            for k, (buf, _, _) in enumerate(pieces):
                mine = piece[at] == k
                if mine.any():
                    value[mine] = scan.substring(scan.prefix_sums(buf), begin[mine], begin[mine] + LENGTH)
            rows = [np.concatenate(x) for x in zip(rows, (key[at], value, np.ones(len(at), np.int64), begin, piece[at]), strict=True)]
            deal = np.concatenate([deal, value])
        key, content, windows, place, piece = rows
        if not len(key):
            return _sent([], [], [], [], [], 0)
        bucket = _by_bucket(deal, buckets)
        order = np.lexsort((content, bucket))
        first = np.flatnonzero(np.r_[True, (content[order][1:] != content[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])])
        lo, hi, one = np.minimum.reduceat(key[order], first), np.maximum.reduceat(key[order], first), order[first]
        start, end = _cuts(bucket[one])
        size = windows[one] + LENGTH - 1
        out_at = np.cumsum(size) - size
        raw = np.empty(int(size.sum()), np.uint8)
        for k, (buf, _, _) in enumerate(pieces):
            mine = np.flatnonzero(piece[one] == k)
            raw[scan.ranges(out_at[mine], size[mine])] = buf[scan.ranges(place[one[mine]], size[mine])]
        edge = np.r_[out_at, len(raw)]
        cols = [[], [], [], [], []]
        for s, e in zip(start.tolist(), end.tolist(), strict=True):
            for c, v in zip(cols, (int(bucket[one[s]]), windows[one[s:e]].astype(np.uint8), lo[s:e], hi[s:e], raw[edge[s] : edge[e]]), strict=True):
                c.append(v if isinstance(v, int) else v.tobytes())
        return _sent(*cols, texts["shard"][0].as_py())

    return run


_SENT = "bucket long, shard long, windows binary, lo binary, hi binary, raw binary"


def _sent(bucket: list, windows: list, lo: list, hi: list, raw: list, shard: int) -> pa.Table:
    blob = lambda x: pa.array(x, pa.binary())
    return pa.table({"bucket": pa.array(bucket, pa.int64()), "shard": pa.array([shard] * len(bucket), pa.int64()), "windows": blob(windows), "lo": blob(lo), "hi": blob(hi), "raw": blob(raw)})


def hashes_of(raw: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and content hash of segments that stand one after the other; cheaper made again than sent."""
    size = windows + LENGTH - 1
    at = np.cumsum(size) - size
    sums = scan.prefix_sums(raw)
    n = len(raw) - K + 1
    low = sliding_min(scan.mix((sums[K:] - sums[:-K]) * scan.powers(len(sums), "down")[:n]), LENGTH - K + 1)
    return low[at], scan.substring(sums, at, at + size)


def smallest_holders(anchor: np.ndarray, windows: np.ndarray, content: np.ndarray, lo: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of segments (equal ones among them): the row's distinct segment, each of these' first window in one
    list of windows, and for every window in the list the smallest key that holds it."""
    size = windows + LENGTH - 1
    at = np.cumsum(size) - size
    _, one, of = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(one), NONE)
    np.minimum.at(least, of, lo)
    n = windows[one]
    begin = np.cumsum(n) - n
    smallest = np.repeat(least, n)
    order = np.lexsort((least, anchor[one]))
    a = anchor[one][order]
    new = np.r_[True, a[1:] != a[:-1]]
    last = np.r_[new[1:], True]
    query = order[~(new & last)]  # anchors with one segment need no index
    source = order[~last]  # what starts last is a source for none but its own copies
    if len(source):
        index = RunIndex(raw[scan.ranges(at[one[source]], size[one[source]])], size[one[source]], least[source], LENGTH)
        own = size[one[query]]
        q, place, label = index.statistics(raw[scan.ranges(at[one[query]], own)], np.cumsum(own) - own, own, LENGTH)
        np.minimum.at(smallest, begin[query[q]] + place, label)
    return of, begin, smallest


def _answer(table: pa.Table) -> pa.Table:
    """For each shard of a bucket: (content, first window, end, smallest key) where some holder's key is larger, and
    the anchors of those that are one window."""
    col = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    windows = col("windows", np.uint8).astype(np.int64)
    lo, hi, raw = col("lo", np.int64), col("hi", np.int64), col("raw", np.uint8)
    anchor, content = hashes_of(raw, windows)
    of, begin, smallest = smallest_holders(anchor, windows, content, lo, raw)
    per = np.array([len(x) for x in table["windows"].to_pylist()])
    shard = np.repeat(np.arange(len(per)), per)
    key = smallest[scan.ranges(begin[of], windows)]
    row = np.repeat(np.arange(len(of)), windows)
    place = scan.ranges(np.zeros(len(windows), np.int64), windows)
    first = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]
    start = np.flatnonzero(first)
    end = np.r_[start[1:], len(key)] - 1
    keep = key[start] < hi[row[start]]
    start, end = start[keep], end[keep]
    out_shard, s = shard[row[start]], table["shard"].to_pylist()
    cuts = np.searchsorted(out_shard, np.arange(len(per) + 1))
    parts = {"content": content[row[start]], "a": place[start].astype(np.uint8), "b": (place[end] + 1).astype(np.uint8), "key": key[start]}
    single, anchors = windows[row[start]] == 1, anchor[row[start]]
    alone = [np.unique(anchors[x:y][single[x:y]]).tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"shard": pa.array(s, pa.int64()), **{k: pa.array([v[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for k, v in parts.items()}, "alone": pa.array(alone, pa.binary())})


def _finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
    col = lambda name, kind: np.frombuffer(b"".join(answers[name].to_pylist()), kind)
    content, a, b, key = col("content", np.uint64), col("a", np.uint8), col("b", np.uint8), col("key", np.int64)
    order = np.argsort(content)
    content, a, b, key = content[order], a[order].astype(np.int64), b[order].astype(np.int64), key[order]
    alone = np.unique(col("alone", np.uint64))  # anchors whose windows were asked about one by one
    out: dict[str, list] = {k: [] for k in ("d", "n_bytes", "n_removed", "runs", "kept_sha256")}
    for keys, there, buf, offsets in _pieces(texts):
        s, own = _keyed(keys, there, buf, offsets)
        cut = np.flatnonzero(np.isin(s.anchor, alone) & (s.windows > 1)) if len(alone) else np.zeros(0, np.int64)
        if len(cut):
            at = np.repeat(cut, s.windows[cut])
            begin = s.start[at] + scan.ranges(np.zeros(len(cut), np.int64), s.windows[cut])
            value = scan.substring(scan.prefix_sums(buf), begin, begin + LENGTH)
            s = Segments(np.r_[s.text, s.text[at]], np.r_[s.start, begin], np.r_[s.windows, np.ones(len(at), np.int64)], np.r_[s.anchor, s.anchor[at]], np.r_[s.content, value])
            own = np.r_[own, own[at]]
        lo, hi = np.searchsorted(content, s.content, "left"), np.searchsorted(content, s.content, "right")
        which, answer = np.repeat(np.arange(len(lo)), hi - lo), scan.ranges(lo, hi - lo)
        ok = key[answer] < own[which]
        which, answer = which[ok], answer[ok]
        change = np.zeros(len(buf) + 1, np.int64)
        np.add.at(change, s.start[which] + a[answer], 1)
        np.add.at(change, s.start[which] + b[answer] + LENGTH - 1, -1)
        gone = np.cumsum(change[:-1]) > 0
        first, last = scan.spans(gone.view(np.uint8), offsets, np.array([False, True] + [False] * 254))
        kept = buf[~gone].tobytes()
        total = np.concatenate([[0], np.cumsum(~gone)])[offsets].tolist()
        cut = np.searchsorted(first, offsets)
        for t in range(len(keys)):
            left, right, base = cut[t], cut[t + 1], offsets[t]
            out["d"].append(int(keys[t]) if there[t] else None)
            out["n_bytes"].append(int(offsets[t + 1] - base))
            out["n_removed"].append(int(offsets[t + 1] - base) - (total[t + 1] - total[t]))
            out["runs"].append(np.stack([first[left:right] - base, last[left:right] - base], 1).ravel().tolist())
            out["kept_sha256"].append(hashlib.sha256(kept[total[t] : total[t + 1]]).hexdigest())
    return pa.table({"d": pa.array(out["d"], pa.int64()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "runs": pa.array(out["runs"], pa.list_(pa.int64())), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})


def repeated_strings(docs: DataFrame, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS, hot_shards: int | None = None) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, runs (start and end of each removed run, in bytes), kept_sha256."""
    ship(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    size = max(shard_bytes, min(MOST_SHARD_BYTES, int((total * PAIR_BYTES) ** 0.5)))
    n = max(least_shards, -(-total // size))
    hot = size >> 10 if hot_shards is None else hot_shards
    d, t = F.col(key).cast("long"), F.col(text)
    x = docs.select(d.alias("d"), t.alias("t"), F.pmod(F.when(d.isNull(), F.xxhash64(t)).otherwise(F.xxhash64(d)), F.lit(n)).cast("long").alias("shard"))
    anchors = x.groupBy("shard").applyInArrow(_anchors(n), "bucket long, shard long, h binary, several binary, many binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared(hot), "shard long, bucket long, bits binary, hot binary")
    sent = x.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(_send(n), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_answer, "shard long, content binary, a binary, b binary, key binary, alone binary")
    out = x.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_finish, "d long, n_bytes long, n_removed long, runs array<long>, kept_sha256 string")
    return out.withColumnRenamed("d", key)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("runs") / 2).cast("long").alias("n_spans"), "kept_sha256")


ORACLE = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, substring(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS p FROM h WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
b AS (SELECT DISTINCT w.doc_id, w.p FROM w JOIN f ON w.s = f.s WHERE m < w.doc_id),
q AS (SELECT doc_id, p, substring(x, 2 * p + 1, 2) AS c FROM (SELECT doc_id, x, unnest(range(0, n)) AS p FROM h)),
g AS (SELECT q.doc_id, q.p, c, max(CASE WHEN b.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY q.doc_id ORDER BY q.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM q LEFT JOIN b ON q.doc_id = b.doc_id AND q.p = b.p),
r AS (SELECT doc_id, p, c, gone, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) AS was FROM g),
a AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE gone = 1 AND was = 0) AS n_spans, string_agg(c, '' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN a ON h.doc_id = a.doc_id
"""
