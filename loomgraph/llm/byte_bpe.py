"""Byte-level BPE encoding and decoding with a rank vocabulary, by a sentencepiece model made from it.

The driver serialises the vocabulary as a sentencepiece model: every byte is mapped to a character of its own
(U+0100 + byte), every token is a piece with its negative rank as score, text is not normalised and no blank is
added or escaped.  Merging the adjacent pair with the best score first is then merging the pair of the lowest rank, so the
library's merges are those of the ranks.

A text is first cut into pre-tokens.  The cuts of ``PATTERN`` depend on runs of four classes of characters (letters,
numbers, white space, others), blanks before runs, and contractions, so they are found in whole-buffer passes over a batch;
the classes of all characters are read off the tiktoken library itself.  The distinct pre-tokens of a batch (equal bytes, by
a hash table that compares them) are encoded once.  A pre-token that is itself in the vocabulary gets its rank at
once, as in the library.  Decoding joins the bytes of the ids.

Defined cases: a null text counts as empty and has no ids, and decodes to no bytes; special tokens are never made, their
strings are ordinary text; other columns and null keys pass through, but those with the names of added ones are replaced;
repeated rows have equal results; pairs of equal rank don't arise, but equal pairs are merged from the left; an empty table
gives an empty result.  Batches are cut to bounded size by bytes, so a very long text is a batch of its own, worked on whole.
The vocabulary has a fixed size and travels by broadcast, so only the driver reads its file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from . import scan
from ..shipping import ship

#: The pattern that these cuts are those of; another one is refused.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Text bytes encoded at once: bounds a worker's memory.
PIECE_BYTES = 1 << 20


def read_ranks(path: str | None = None) -> list[bytes]:
    """The tokens of a rank file, in the order of their ranks, which must be 0, 1, ..."""
    if path is None:
        import public_tokenizers

        if public_tokenizers.PATTERN != PATTERN:
            raise ValueError("the vocabulary's pattern is not the one that this module cuts by")
        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, ...")
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol-buffer message."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def mapped(token: bytes) -> str:
    return "".join(chr(0x100 + b) for b in token)


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece model whose piece i is token i, and whose unknown piece comes after them."""
    pieces = [_field(1, _field(1, mapped(t).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, t in enumerate(tokens)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))  # BPE; no begin, end or padding
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


def classes() -> np.ndarray:
    """The class of every code point, as tiktoken's regular expressions see it."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        out[np.frombuffer(bytes(probe.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind  # the rest is not matched
    return out


class Vocabulary:
    def __init__(self, tokens: list[bytes], proto: bytes, kinds: np.ndarray) -> None:
        import sentencepiece

        self.sp, self.kinds = sentencepiece.SentencePieceProcessor(model_proto=proto), kinds
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.buf = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def units(self, tokens: list[bytes]) -> list[list[int]]:
        """The ids of pre-tokens."""
        given = [self.rank.get(t) for t in tokens]
        rest = [k for k, r in enumerate(given) if r is None]
        out = [[r] for r in given]
        for k, ids in zip(rest, self.sp.encode([mapped(tokens[k]) for k in rest], num_threads=1) if rest else [], strict=True):
            out[k] = ids
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        raw = self.buf[scan.ranges(self.starts[ids], self.sizes[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[offsets]
        return [raw[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def cuts(code: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The starts of the pre-tokens of texts, given as code points one after the other."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[code]
    first = np.zeros(n + 1, bool)  # of a text
    first[offsets] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # a white-space run before another character of its text ends in a token of its own, which a blank gives to what follows
    last = (kind == SPACE) & ~first[1:]
    last[:-1] &= kind[1:] != SPACE
    last = np.flatnonzero(last)
    start[last] = True
    joined = last[code[last] == 32] + 1
    start[joined] = False
    # a contraction is a token where its apostrophe begins one
    padded = np.concatenate([code, np.zeros(2, code.dtype)])
    quote = np.flatnonzero((code == 39) & start)
    quote = quote[~first[quote + 1]]
    for tail in CONTRACTIONS:
        at = quote[padded[quote + 1] == ord(tail[0])]
        if len(tail) == 2:
            at = at[(padded[at + 2] == ord(tail[1])) & ~first[at + 2]]
        start[at + 1] = False
        after = at + 1 + len(tail)
        start[after[after < n]] = True
    return np.flatnonzero(start)


def encode(column: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and each text's offset (one more at the end)."""
    buf, offsets = scan.texts_of(column)
    code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)  # the byte at which each character begins
    at = np.append(lead, len(buf))[cuts(code, np.searchsorted(lead, offsets), v.kinds)]
    ends = np.append(at, len(buf))
    units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(buf)])
    distinct = pc.dictionary_encode(units)
    of, own = np.asarray(distinct.indices), v.units(distinct.dictionary.to_pylist())
    size = np.array([len(x) for x in own], np.int64)
    flat = np.array([i for x in own for i in x], np.int32)
    begin = np.cumsum(size) - size
    count = size[of]
    out = flat[scan.ranges(begin[of], count)] if len(of) else np.zeros(0, np.int32)
    return out, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(at, offsets)]


@lru_cache(maxsize=1)
def _vocabulary(packed: bytes, proto: bytes, kinds: bytes) -> Vocabulary:
    return Vocabulary([base64.b64decode(t) for t in packed.split(b"\n")], proto, np.frombuffer(kinds, np.uint8))


def _given(spark: SparkSession, tokens: list[bytes] | None):  # noqa: ANN202
    ship(spark)
    tokens = read_ranks() if tokens is None else tokens
    return spark.sparkContext.broadcast((b"\n".join(base64.b64encode(t) for t in tokens), model_proto(tokens), classes().tobytes()))


def encoded(docs: DataFrame, text: str = "text", tokens: list[bytes] | None = None, ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """``docs`` with the ids of every text and, if asked for, the bytes they decode to."""
    given, kept = _given(docs.sparkSession, tokens), docs.drop(ids, *([decoded] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(*given.value)
        for b in scan.pieces_of(batches, text, PIECE_BYTES):
            out, offsets = encode(b.column(text), v)
            columns, names = [*b.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))], [*b.schema.names, ids]
            if decoded:
                columns, names = [*columns, pa.array(v.decode(out, offsets), pa.binary())], [*names, decoded]
            yield pa.RecordBatch.from_arrays(columns, names)

    more = [StructField(ids, ArrayType(IntegerType())), *([StructField(decoded, BinaryType())] if decoded else [])]
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *more]))


def digests(docs: DataFrame, text: str = "text", tokens: list[bytes] | None = None) -> DataFrame:
    """The other columns of ``docs`` with n_tokens and the digests of the ids and of the decoded bytes."""
    given, own = _given(docs.sparkSession, tokens), docs.drop("n_tokens", "ids_sha256", "decoded_sha256")
    fields = [f for f in own.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(*given.value)
        for b in scan.pieces_of(batches, text, PIECE_BYTES):
            out, offsets = encode(b.column(text), v)
            raw = out.astype("<u4")
            hashes = [hashlib.sha256(raw[s:e]).hexdigest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            back = [hashlib.sha256(x).hexdigest() for x in v.decode(out, offsets)]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], pa.array(np.diff(offsets)), pa.array(hashes, pa.string()), pa.array(back, pa.string())], [*[f.name for f in fields], "n_tokens", "ids_sha256", "decoded_sha256"])

    return own.mapInArrow(run, StructType([*fields, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
