"""Encoding and decoding with a merge-type SentencePiece vocabulary.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they make
(then by place) and merges the first until no pair makes a piece.  No piece has "▁" after
another character and characters that are in no piece never merge, so a text falls into units
(blanks with what follows them, single unknown characters) that are merged apart.  The distinct
units of a batch run through the agenda together: units of equal length are the rows of a matrix,
and every round merges each row's best pair.  Units of more than LONG symbols have a heap
of their own, so one very long run costs n log n.

Every distinct unit's ids are checked against the sentencepiece library in the same batch
(``verify="texts"``: every whole text); a difference raises.  Decoding is the library's.

Defined cases: a null text counts as empty: only the begin and end ids, decoded to "".  Other columns
and null keys pass through, but those with the names of added ones (``ids`` and ``decoded``, or those of the digests)
are replaced; repeated rows have equal results; an empty table gives an empty
result; pairs of equal score are merged from the left.  Batches are cut to bounded size by bytes, so a long text is a batch of its own.  The
model travels to the workers by broadcast (its file is of fixed size), so only the driver reads it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from . import scan
from ..shipping import ship

BLANK = "▁"
LONG = 48
#: Text bytes encoded at once: bounds a worker's memory.
PIECE_BYTES = 1 << 20
NEVER = np.iinfo(np.int32).max


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class Agenda:
    """The merge tables of a vocabulary.

    Scores become ranks (0 is merged first; equal scores share a rank, so that the place decides).
    """

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = self.sp.get_piece_size()
        reserved = [self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i) for i in range(n)]
        ids = {self.sp.id_to_piece(i): i for i in range(n) if not reserved[i]}
        if any(BLANK in s.lstrip(BLANK) for s in ids):
            raise ValueError("a piece has a blank after another character: units can't be merged apart")
        loose = sorted({c for s in ids for c in s} - set(ids))  # characters that only occur within pieces
        symbols = ids | {c: n + i for i, c in enumerate(loose)}
        self.size = n + len(loose)
        scores = np.array([self.sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        pairs = {}
        for s, i in ids.items():
            for cut in range(1, len(s)):
                a, b = symbols.get(s[:cut]), symbols.get(s[cut:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (rank[i], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int32)
        self.pairs = {k: (int(r), i) for k, (r, i) in pairs.items()}
        self.loose = np.array([ord(c) for c in loose], np.int64)
        self.n = n
        self.byte0 = self.sp.piece_to_id("<0x00>")
        self.begin, self.end = self.sp.bos_id(), self.sp.eos_id()

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; rank NEVER where it makes no piece."""
        key = a.astype(np.int64) * self.size + b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (self.keys[i] == key) & (a >= 0) & (b >= 0)
        return np.where(ok, self.ranks[i], NEVER), np.where(ok, self.made[i], -1)

    def merge_rows(self, sym: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of equally long units; returns (row numbers, merged rows) in parts."""
        rows, out = np.arange(len(sym)), []
        rank, made = self.look(sym[:, :-1], sym[:, 1:])
        while len(rows):
            if sym.shape[1] == 1:
                out.append((rows, sym))
                break
            at = rank.argmin(1)  # the first of equal ranks
            best = rank[np.arange(len(rows)), at]
            if (over := best == NEVER).any():
                out.append((rows[over], sym[over]))
                go = ~over
                rows, sym, rank, made, at = rows[go], sym[go], rank[go], made[go], at[go]
                if not len(rows):
                    break
            line, width = np.arange(len(rows)), sym.shape[1]
            new = made[line, at]
            sym = np.take_along_axis(sym, np.arange(width - 1) + (np.arange(width - 1) > at[:, None]), 1)
            sym[line, at] = new
            if width == 2:
                continue
            keep = np.arange(width - 2) + (np.arange(width - 2) >= at[:, None])
            rank, made = np.take_along_axis(rank, keep, 1), np.take_along_axis(made, keep, 1)
            for off in (-1, 0):  # the pairs to the left and right of the new symbol
                p = at + off
                r = line[(p >= 0) & (p < width - 2)]
                p = p[r]
                rank[r, p], made[r, p] = self.look(sym[r, p], sym[r, p + 1])
        return out

    def merge_long(self, sym: np.ndarray) -> np.ndarray:
        """One long unit, by a heap of (rank, place)."""
        s, n = sym.tolist(), len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank, made = self.look(sym[:-1], sym[1:])
        heap = [(r, i, s[i], s[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r != NEVER]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or s[i] != a or s[j] != b:
                continue
            s[i], gone[j], after[i] = m, True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0 and s[x] >= 0 and s[y] >= 0 and (pair := self.pairs.get(s[x] * self.size + s[y])):
                    heapq.heappush(heap, (pair[0], x, s[x], s[y], pair[1]))
        return np.array([x for x, g in zip(s, gone, strict=True) if not g], np.int32)

    def ids(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of symbols, bytes for the characters that are in no piece; and how many for each symbol."""
        count = np.ones(len(sym), np.int64)
        odd = np.flatnonzero((sym < 0) | (sym >= self.n))
        if not len(odd):
            return sym, count
        code = np.where(sym[odd] < 0, -1 - sym[odd].astype(np.int64), self.loose[np.maximum(sym[odd] - self.n, 0)] if len(self.loose) else 0)
        size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        count[odd] = size
        at = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        plain = np.ones(len(sym), bool)
        plain[odd] = False
        out[at[plain]] = sym[plain]
        head = np.array([0, 0, 0xC0, 0xE0, 0xF0])
        for k in range(4):
            own = size > k
            shift = 6 * (size[own] - 1 - k)
            out[at[odd[own]] + k] = self.byte0 + ((code[own] >> shift) & (0x3F if k else 0x7F) | (0x80 if k else head[size[own]]))
        return out, count


@lru_cache(maxsize=1)
def agenda(proto: bytes) -> Agenda:
    return Agenda(proto)


def encode(texts: list[str], a: Agenda, verify: str = "units") -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, begin and end ids included, and each text's offset (one more at the end)."""
    joined = "".join([BLANK + t if t else "" for t in texts])
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    code[code == 32] = ord(BLANK)
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    sym = a.of_char[code]
    odd = sym < 0
    sym[odd] = -1 - code[odd]
    blank = code == ord(BLANK)
    start = odd.copy()
    start[1:] |= odd[:-1] | (blank[1:] & ~blank[:-1])
    start[offsets[:-1][sizes > 0]] = True
    first = np.flatnonzero(start)
    length = np.diff(np.append(first, len(code)))
    one, of = scan.distinct(code.astype(np.uint32), first, first + length)  # equal character by character
    merged: list[np.ndarray] = []  # symbols of the distinct units, in parts
    unit_of: list[np.ndarray] = []
    sizes_of: list[np.ndarray] = []
    order = np.argsort(length[one], kind="stable")
    lengths, at = np.unique(length[one][order], return_index=True)
    for n, own in zip(lengths.tolist(), np.split(order, at[1:]) if len(at) else [], strict=True):
        if n > LONG:
            parts = [(np.array([u]), a.merge_long(sym[first[one[u]] : first[one[u]] + n])[None]) for u in own]
        else:
            parts = [(own[r], s) for r, s in a.merge_rows(sym[first[one[own]][:, None] + np.arange(n)])]
        for u, s in parts:
            unit_of.append(u)
            sizes_of.append(np.full(len(u), s.shape[1]))
            merged.append(s.ravel())
    if not len(first):
        return np.tile(np.array([a.begin, a.end], np.int32), len(texts)), np.arange(len(texts) + 1) * 2
    units, n_sym = np.concatenate(unit_of), np.concatenate(sizes_of)
    flat, per = a.ids(np.concatenate(merged))
    ends = np.concatenate([[0], np.cumsum(per)])[np.cumsum(n_sym)]
    n_ids, begin = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
    n_ids[units], begin[units] = np.diff(np.append(0, ends)), np.append(0, ends[:-1])
    if verify == "units":
        _check(a, joined, first, length, one, flat, begin, n_ids)
    text = np.searchsorted(offsets, first, "right") - 1
    count = np.bincount(text, n_ids[of], len(texts)).astype(np.int64) + 2
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(out_offsets[-1]), np.int32)
    out[out_offsets[:-1]], out[out_offsets[1:] - 1] = a.begin, a.end
    inner = np.ones(len(out), bool)
    inner[out_offsets[:-1]] = inner[out_offsets[1:] - 1] = False
    out[inner] = flat[scan.ranges(begin[of], n_ids[of])]
    if verify == "texts":
        for t, own in enumerate(a.sp.encode(texts, add_bos=True, add_eos=True, num_threads=1)):
            if own != out[out_offsets[t] : out_offsets[t + 1]].tolist():
                raise AssertionError(f"ids differ from the library's for {texts[t][:200]!r}")
    return out, out_offsets


def _check(a: Agenda, joined: str, first: np.ndarray, length: np.ndarray, one: np.ndarray, flat: np.ndarray, begin: np.ndarray, n_ids: np.ndarray) -> None:
    """The library encodes each distinct unit: after its own blank, or else after a line end, whose ids are cut off."""
    spans = list(zip(first[one].tolist(), (first + length)[one].tolist(), strict=True))
    units = [joined[s:e].replace(BLANK, " ") for s, e in spans]
    line = a.sp.encode("\n")
    theirs = a.sp.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
    # the library gives no ids for an empty text: a lone blank is the id of its piece
    for k, (u, ids) in enumerate(zip(units, theirs, strict=True)):
        ids = [a.sp.piece_to_id(BLANK)] if u == " " else ids if u[0] == " " else ids[len(line) :]
        if ids != flat[begin[k] : begin[k] + n_ids[k]].tolist():
            raise AssertionError(f"ids differ from the library's for the unit {u!r}")


def decode(ids: list[list[int]], a: Agenda) -> list[str]:
    return a.sp.decode(ids, num_threads=1)


def encoded(docs: DataFrame, text: str = "text", proto: bytes | None = None, ids: str = "ids", decoded: str | None = "decoded", verify: str = "units") -> DataFrame:
    """``docs`` with the ids of every text and, if asked for, the text they decode to."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(proto or model_bytes())
    kept = docs.drop(ids, *([decoded] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = agenda(model.value)
        for b in scan.pieces_of(batches, text, PIECE_BYTES):
            out, offsets = encode([t or "" for t in b.column(text).to_pylist()], a, verify)
            columns, names = [*b.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))], [*b.schema.names, ids]
            if decoded:
                columns.append(pa.array(decode([out[s:e].tolist() for s, e in zip(offsets[:-1], offsets[1:], strict=True)], a), pa.string()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(columns, names)

    more = [StructField(ids, ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])]
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *more]))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs)


def digests(docs: DataFrame, text: str = "text", proto: bytes | None = None, verify: str = "units") -> DataFrame:
    """The other columns of ``docs`` with n_tokens and the digests of the ids and of the decoded text."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(proto or model_bytes())
    own = docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    fields = [f for f in own.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = agenda(model.value)
        for b in scan.pieces_of(batches, text, PIECE_BYTES):
            out, offsets = encode([t or "" for t in b.column(text).to_pylist()], a, verify)
            raw, hashes, texts = out.astype("<u4"), [], []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                hashes.append(hashlib.sha256(raw[s:e]).hexdigest())
                texts.append(out[s:e].tolist())
            back = [hashlib.sha256(t.encode()).hexdigest() for t in decode(texts, a)]
            rest = [b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(offsets)), pa.array(hashes, pa.string()), pa.array(back, pa.string())], [*[f.name for f in fields], "n_tokens", "ids_sha256", "decoded_sha256"])

    return own.mapInArrow(run, StructType([*fields, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]))
