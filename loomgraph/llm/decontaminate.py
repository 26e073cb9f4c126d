"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all documents.

A window is ``N`` consecutive words of an item (a shorter item is one window).  Documents are
scanned in Arrow batches: the hashes of all their windows come from running sums, a bit table
drops nearly all of them, the rest are looked up and every hit is verified byte by byte, all of
a batch together.

The benchmark is first normalised on the executors, and long items are cut into parts of at most
``PART_WORDS`` words that overlap by ``N - 1`` words, so that they have the same windows.  Parts are
dealt into blocks of at most about ``MOST_BYTES`` of words.  The driver and every worker hold one
block's index at a time: it consists of flat arrays, 7 bytes a byte of words (measured: 70 MB for 10 MB of words, built in 6 s within 0.5 GB; 8 MB are the default
limit).  Usually there is one block.  With several, each is collected, broadcast and scanned
in its own pass, the pass's hits are written to the shared folder and the index is dropped before the next
block; the hits of the passes are merged by document, or by text in ``remove``.

Defined cases: a null or empty text has no words and is never contaminated; an item without
words has no window; an item_id that is null counts as the empty id; repeated items count once;
repeated documents each get their own, equal row; null doc_ids pass through; an empty benchmark
leaves every document clean; windows that several items share count for each of them, whatever their
order, and take the room of one set of items.  Very long texts are scanned whole, in time in proportion to their words and hits.  Other columns are ignored by
``find``, and kept by ``remove`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .folders import checkpointed
from .native_spans import fresh
from ..shipping import ship

N = 13
PART_WORDS = 1 << 15
MOST_BYTES = 8 << 20
#: The bit table has 2 ** BITS places for the most, 16 for each window at least.
BITS = 24
#: Hits verified at once.
VERIFIED = 1 << 14
#: Items of texts that are named in one batch of rows.
ITEMS = 1 << 18


@dataclass
class Windows:
    """The distinct windows of one length: sorted hashes, the first word of each, and the number of its set of items."""

    hashes: np.ndarray
    shift: np.uint64
    bits: np.ndarray
    word: np.ndarray
    sets: np.ndarray


@dataclass
class Index:
    """A block of items: their words' bytes, each word's start and end, the windows by length, and the distinct sets of items that
    share a window (first place, items in order of their names); sets of one item come first, by item."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    windows: dict[int, Windows]
    names: list[str]
    first: np.ndarray
    items: np.ndarray

    @property
    def nbytes(self) -> int:
        parts = [self.raw, self.starts, self.ends, *(x for w in self.windows.values() for x in (w.hashes, w.bits, w.word, w.sets)), self.first, self.items]
        return sum(x.nbytes for x in parts) + sum(len(x) + 50 for x in self.names)

    def named(self, sets: np.ndarray) -> list[str]:
        """The distinct items of some sets, sorted."""
        own = [self.items[self.first[k] : self.first[k + 1]] for k in sets]
        return [self.names[i] for i in (own[0] if len(own) == 1 else np.unique(np.concatenate(own)))]


def window_hashes(word_hashes: np.ndarray, n: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all n consecutive words, in constant time each."""
    sums = word_sums(word_hashes) if sums is None else sums
    if len(word_hashes) < n:
        return np.zeros(0, np.uint64)
    return scan.mix((sums[n:] - sums[:-n]) * scan.powers(len(sums), "down")[: len(sums) - n])


def word_sums(word_hashes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(word_hashes) + 1, np.uint64)
    np.cumsum(word_hashes * scan.powers(len(word_hashes)), out=sums[1:])
    return sums


def equal_words(a: tuple[np.ndarray, np.ndarray, np.ndarray], p: np.ndarray, b: tuple[np.ndarray, np.ndarray, np.ndarray], q: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from p[i] on of ``a`` (bytes, starts, ends) are those from q[i] on of ``b``."""
    ok = np.ones(len(p), bool)
    for at in range(0, len(p), VERIFIED):
        own = np.arange(at, min(at + VERIFIED, len(p)))
        for j in range(n):  # the hits that are left lose those that differ in this word
            x, y = p[own] + j, q[own] + j
            size = a[2][x] - a[1][x]
            same = size == b[2][y] - b[1][y]
            own, size, x, y = own[same], size[same], a[1][x[same]], b[1][y[same]]
            if not len(own):
                break
            differ = a[0][scan.ranges(x, size)] != b[0][scan.ranges(y, size)]
            ok_here = np.add.reduceat(differ, np.cumsum(size) - size) == 0  # words have a byte at least
            own = own[ok_here]
        good = np.zeros(min(at + VERIFIED, len(p)) - at, bool)
        good[own - at] = True
        ok[at : at + VERIFIED] = good
    return ok


def build(items: list[tuple[str | None, str | None]], n: int = N) -> Index:
    """The index of (item id as a string, text) rows."""
    buf, offsets = scan.texts_of(pa.array([t for _, t in items], pa.large_string()))
    buf = scan.LOWER[buf]
    starts, ends, h, first = scan.words(buf, offsets, scan.ALNUM)
    names = sorted({i or "" for i, _ in items})
    place = {x: k for k, x in enumerate(names)}
    item = np.array([place[i or ""] for i, _ in items], np.int64)
    size, sums, index = np.diff(first), word_sums(h), Index(buf, starts, ends, {}, names, np.zeros(1, np.int64), np.zeros(0, np.int64))
    shared: dict[bytes, int] = {}  # the items of a window that has several, and the number of this set
    for k in sorted({int(x) for x in np.unique(np.minimum(size, n)) if x}):
        rows = np.flatnonzero(size >= n if k == n else size == k)
        per = size[rows] - k + 1
        word, owner = scan.ranges(first[rows], per), np.repeat(item[rows], per)
        value = window_hashes(h, k, sums)[word]
        order = np.lexsort((owner, value))
        word, owner, value = word[order], owner[order], value[order]
        new = np.r_[True, value[1:] != value[:-1]]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        own = (buf, starts, ends)
        odd = ~equal_words(own, word, own, word[lead], k)  # other words of an equal hash: windows of their own
        again = ~new & ~odd & np.r_[False, owner[1:] == owner[:-1]]
        if odd.any():
            order = np.lexsort((np.where(odd, np.arange(len(odd)) + 1, 0), value))
            word, owner, value, odd, again = word[order], owner[order], value[order], odd[order], again[order]
            new = np.r_[True, (value[1:] != value[:-1])] | odd
        keep = ~again | new
        word, owner, value, new = word[keep], owner[keep], value[keep], new[keep]
        at = np.flatnonzero(new)
        bits = int(min(BITS, max(10, np.ceil(np.log2(16 * len(at))))))
        table = np.zeros(1 << bits, bool)
        shift = np.uint64(64 - bits)
        table[value[at] >> shift] = True
        sets, to = owner[at], np.append(at[1:], len(owner))
        for j in np.flatnonzero(to - at > 1):
            own = owner[at[j] : to[j]]
            own = np.unique(own) if odd.any() else own
            if len(own) > 1:
                sets[j] = shared.setdefault(own.tobytes(), len(names) + len(shared))
        index.windows[k] = Windows(value[at], shift, np.packbits(table), word[at], sets)
    several = [np.frombuffer(x, np.int64) for x in shared]
    index.items = np.concatenate([np.arange(len(names)), *several])
    index.first = np.concatenate([[0], np.cumsum([1] * len(names) + [len(x) for x in several])]).astype(np.int64)
    return index


def _set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def hits(index: Index, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Word starts and ends, the first word of each text, a flag per word, and the distinct pairs (text, set of items) by text.

    A prompt that many items share is one set, so that no row is made for each of them.
    """
    starts, ends, h, first = scan.words(buf, offsets, scan.ALNUM)
    change, pairs = np.zeros(len(h) + 1, np.int64), [np.zeros(0, np.int64)]
    sums, n_sets = word_sums(h), max(len(index.first) - 1, 1)
    for size, w in index.windows.items():
        own = window_hashes(h, size, sums)
        at = np.flatnonzero(_set(w.bits, own >> w.shift))
        lo, hi = np.searchsorted(w.hashes, own[at], "left"), np.searchsorted(w.hashes, own[at], "right")
        at, which = np.repeat(at, hi - lo), scan.ranges(lo, hi - lo)
        text = np.searchsorted(first, at, "right") - 1
        ok = at + size <= first[text + 1]
        at, which, text = at[ok], which[ok], text[ok]
        ok = equal_words((buf, starts, ends), at, (index.raw, index.starts, index.ends), w.word[which], size)
        at, which, text = at[ok], which[ok], text[ok]
        np.add.at(change, at, 1)
        np.add.at(change, at + size, -1)
        pairs.append(np.unique(text * n_sets + w.sets[which]))
    found = np.unique(np.concatenate(pairs))
    return starts, ends, first, np.cumsum(change[:-1]) > 0, (found // n_sets, found % n_sets)


def parts(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(i, t, n): the distinct parts of the items, as words joined by blanks, and their bytes."""
    ship(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan.pieces_of(batches, "t"):
            buf, offsets = scan.texts_of(b.column("t"))
            buf = scan.LOWER[buf]
            starts, ends = scan.spans(buf, offsets, scan.ALNUM)
            raw, first, names = buf.tobytes(), np.searchsorted(starts, offsets).tolist(), b.column("i").to_pylist()
            for name, lo, hi in zip(names, first[:-1], first[1:], strict=True):
                for at in range(lo, max(hi - N + 1, lo + 1) if hi > lo else lo, PART_WORDS):
                    to = min(at + PART_WORDS + N - 1, hi)
                    words = b" ".join(raw[s:e] for s, e in zip(starts[at:to].tolist(), ends[at:to].tolist(), strict=True)).decode()
                    yield pa.RecordBatch.from_pydict({"i": pa.array([name], pa.string()), "t": pa.array([words], pa.string()), "n": pa.array([len(words)], pa.int64())})

    return benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).mapInArrow(run, "i string, t string, n long").distinct()


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> tuple[int, Callable[[int], list[tuple[str | None, str | None]]]]:
    """The number of blocks, and a function that collects the items of one of them."""
    own = checkpointed(parts(benchmark, item, text))
    total = own.agg(F.sum("n")).first()[0] or 0
    n = -(-total // most) or 1
    block = lambda k: F.pmod(F.xxhash64("i", "t"), F.lit(k))
    while n > 1:  # a block that came out too large by chance
        largest = own.groupBy(block(n).alias("b")).agg(F.sum("n").alias("s"), F.count("*").alias("k")).agg(F.max(F.when(F.col("k") > 1, F.col("s")))).first()[0]
        if (largest or 0) <= 2 * most:
            break
        n *= 2
    return n, lambda k: [(r["i"], r["t"]) for r in (own.where(block(n) == k) if n > 1 else own).select("i", "t").collect()]


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def hit_runs(flag: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """Start and end, in words, of each run of hit words of each text."""
    total = np.concatenate([[0], np.cumsum(flag)])
    runs: list[list[int]] = [[] for _ in first[1:]]
    for t in np.flatnonzero(total[first[1:]] > total[first[:-1]]):
        own = np.flatnonzero(flag[first[t] : first[t + 1]])
        edges = np.flatnonzero(np.diff(own) > 1)
        runs[t] = [x for s, e in zip(own[np.r_[0, edges + 1]], own[np.r_[edges, len(own) - 1]] + 1, strict=True) for x in (int(s), int(e))]
    return runs


def _counted(flag: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[first[1:]] - total[first[:-1]]


def _contaminated(n_hit: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _passes(own: DataFrame, n: int, block: Callable[[int], list], schema: str, run: Callable) -> DataFrame:
    """The rows that ``run`` makes of ``own`` (rows with a text _text) under each block's index, written pass by pass."""
    spark, out = own.sparkSession, None
    for k in range(n):
        index = spark.sparkContext.broadcast(build(block(k)))
        part = checkpointed(own.mapInArrow(run(index), schema))
        index.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _hits_only(rest: str, named: bool = True) -> Callable:
    """Rows with hits: the column ``rest``, n_words, the runs of hit words and, if ``named``, the items (else none); a batch has
    about ITEMS of them for the most."""

    def of(index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in scan.pieces_of(batches, "_text"):
                buf, offsets = scan.texts_of(b.column("_text"))
                _, _, first, flag, (text, which) = hits(index.value, scan.LOWER[buf], offsets)
                cut, n_words, runs = np.searchsorted(text, np.arange(len(first))), np.diff(first), hit_runs(flag, first)
                some = np.flatnonzero(_counted(flag, first) > 0)
                pending, items = 0, []
                for k, t in enumerate(some):
                    items.append(index.value.named(which[cut[t] : cut[t + 1]]) if named else [])
                    pending += len(items[-1])
                    if pending >= ITEMS or k + 1 == len(some):
                        at = some[k + 1 - len(items) : k + 1]
                        out = {rest: b.column(rest).take(pa.array(at)), "n_words": pa.array(n_words[at]), "runs": pa.array([runs[x] for x in at], pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
                        yield pa.RecordBatch.from_pydict(out)
                        pending, items = 0, []

        return run

    return of


def _merged_hits(runs: str) -> Column:
    """The number of words in the union of runs (start, end, start, end, ...)."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(runs) - 2, F.lit(2)), lambda i: F.struct(F.get(runs, i).alias("s"), F.get(runs, i + 1).alias("e"))))
    zero = F.lit(0).cast("long")
    step = lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"), (a["n"] + F.greatest(zero, x["e"] - F.greatest(a["to"], x["s"]))).alias("n"))
    return F.aggregate(pairs, F.struct(zero.alias("to"), zero.alias("n")), step, lambda a: a["n"])


def _union_by(found: DataFrame, *by: str) -> DataFrame:
    """(by, n_words, runs, items, n_hit): the hits of all passes, equal rows once."""
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    out = found.groupBy(*by).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("runs")).alias("runs"), items.alias("items"))
    return out.withColumn("n_hit", _merged_hits("runs"))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", most: int = MOST_BYTES) -> DataFrame:
    """One row per document: its key and SCHEMA."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text"))
    kind = own.schema["_k"].dataType.simpleString()
    n, block = blocks(benchmark, item, item_text, most)
    if n == 1:
        index = spark.sparkContext.broadcast(build(block(0)))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            empty = _digest([])
            for b in scan.pieces_of(batches, "_text"):
                buf, offsets = scan.texts_of(b.column("_text"))
                _, _, first, flag, (of, which) = hits(index.value, scan.LOWER[buf], offsets)
                n_hit, n_words = _counted(flag, first), np.diff(first)
                cut, shas, n_items = np.searchsorted(of, np.arange(len(first))), [empty] * b.num_rows, np.zeros(b.num_rows, np.int64)
                told: dict[bytes, tuple[int, str]] = {}  # of texts that meet the same sets
                for t in np.flatnonzero(np.diff(cut)):
                    own = which[cut[t] : cut[t + 1]]
                    if (same := own.tobytes()) not in told:
                        found = index.value.named(own)
                        told[same] = len(found), _digest(found)
                    n_items[t], shas[t] = told[same]
                yield pa.RecordBatch.from_pydict({"_k": b.column("_k"), "n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "n_items": pa.array(n_items), "items_sha256": pa.array(shas, pa.string()), "contaminated": pa.array(_contaminated(n_hit, n_words))})

        return own.mapInArrow(whole, f"_k {kind}, {SCHEMA}").withColumnRenamed("_k", key)

    # several passes: hits are merged by (key, text), which identifies a row and its copies
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan.pieces_of(batches, "_text"):
            buf, offsets = scan.texts_of(b.column("_text"))
            starts, _ = scan.spans(scan.LOWER[buf], offsets, scan.ALNUM)
            yield pa.RecordBatch.from_pydict({"_id": b.column("_id"), "n_words": pa.array(np.diff(np.searchsorted(starts, offsets)))})

    own = own.select(F.struct("_k", F.sha2(F.coalesce("_text", F.lit("")), 256).alias("same")).alias("_id"), "_text")
    name = f"struct<_k:{kind},same:string>"
    merged = _union_by(_passes(own, n, block, f"_id {name}, n_words long, runs array<long>, items array<string>", _hits_only("_id")), "_id").select(F.col("_id").alias("_hit"), "n_hit", "items")
    base = own.mapInArrow(counted, f"_id {name}, n_words long")
    on = (base["_id.same"] == merged["_hit.same"]) & base["_id._k"].eqNullSafe(merged["_hit._k"])
    out = base.join(merged, on, "left").select(F.col("_id._k").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select(F.col(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def without_runs(texts: list[str], runs: list[list[int] | None]) -> list[str]:
    """The texts without the words of the runs (start, end, start, end, ...; overlapping ones too) and what is between them."""
    out = list(texts)
    for t, own in enumerate(runs):
        if not own:
            continue
        raw = np.frombuffer(texts[t].encode(), np.uint8)
        starts, ends = scan.spans(scan.LOWER[raw], np.array([0, len(raw)]), scan.ALNUM)
        gone = np.zeros(len(starts) + 1, np.int64)
        np.add.at(gone, own[::2], 1)
        np.add.at(gone, own[1::2], -1)
        runs_of = hit_runs(np.cumsum(gone[:-1]) > 0, np.array([0, len(starts)]))[0]
        at, kept = 0, []
        for s, e in zip(runs_of[::2], runs_of[1::2], strict=True):
            kept.append(raw[at : starts[s]].tobytes())
            at = ends[e - 1]
        out[t] = b"".join([*kept, raw[at:].tobytes()]).decode()
    return out


def remove(docs: DataFrame, benchmark: DataFrame, how: str = "documents", text: str = "text", item: str = "item_id", item_text: str = "text", most: int = MOST_BYTES) -> DataFrame:
    """``docs`` without contaminated documents ("documents") or without the hit words ("spans"); the same columns."""
    if how not in ("documents", "spans"):
        raise ValueError(f"how must be documents or spans, not {how!r}")
    spark = docs.sparkSession
    ship(spark)
    n, block = blocks(benchmark, item, item_text, most)
    if n == 1:
        index = spark.sparkContext.broadcast(build(block(0)))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in scan.pieces_of(batches, text):
                buf, offsets = scan.texts_of(b.column(text))
                _, _, first, flag, _ = hits(index.value, scan.LOWER[buf], offsets)
                if how == "documents":
                    yield b.filter(pa.array(~_contaminated(_counted(flag, first), np.diff(first))))
                elif not flag.any():
                    yield b
                else:
                    place = b.schema.get_field_index(text)
                    yield b.set_column(place, b.schema.field(place), pa.array(without_runs(b.column(place).to_pylist(), hit_runs(flag, first)), b.schema.field(place).type))

        return docs.mapInArrow(clean, docs.schema)
    # several passes: what hits a text depends on the text alone, so hits are merged by its digest
    same = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)
    own = docs.select(same.alias("_same"), F.col(f"`{text}`").alias("_text"))
    merged = _union_by(_passes(own, n, block, "_same string, n_words long, runs array<long>, items array<string>", _hits_only("_same", named=False)), "_same")
    mark = fresh(docs, "_same")
    if how == "documents":
        dirty = merged.where("n_hit > 0 and 20 * n_hit >= n_words").select(F.col("_same").alias(mark))
        return docs.join(dirty, same == F.col(mark), "left_anti")
    dirty = merged.select(F.col("_same").alias(mark), F.struct("runs").alias(f"{mark}_runs"))
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), same.alias("own")).join(dirty, F.col("own") == F.col(mark), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column("runs").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(without_runs(b.column("t").to_pylist(), runs), pa.string()), b.column("row")], ["t", "row"])

    kind = joined.schema["row"].dataType.simpleString()
    out = joined.select(F.col("row")[text].alias("t"), F.col(f"{mark}_runs.runs").alias("runs"), "row").mapInArrow(cut, f"t string, row {kind}")
    return out.select(*[F.col("t").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g
      FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM g),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, s WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, dw.n AS n, p FROM dw JOIN g ON dw.n = g.n AND dw.g = g.g),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
