"""Language identification with segmentation-marginalised unigrams.

Each language has a unigram distribution over the pieces of a fixed public vocabulary (lower-case
letter pieces, "▁" marking a word's start, and all single bytes, so that every text has a
segmentation).  A text's likelihood is the product over its words of the sum over all
segmentations of the word, by the forward algorithm.  Training: one count of all piece
occurrences, then ``ROUNDS`` of expectation-maximisation (forward-backward) over a sample.

The sample is bounded: about ``TRAIN_ROWS`` documents a language, chosen by a hash of the row's
text and key, and every language with labelled rows is learned.  Scoring covers every
document and whole texts: words are letter runs; distinct words of a batch are scored once, all
languages together.  Words of any length are scored whole, with rescaled probabilities.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows with a null key
or language are never learned from, but are predicted; with nothing to learn from, all are
``und``; ties go to the language first in order; repeated rows have equal results; other columns
are ignored.  Lost executors only repeat their tasks; the sample is checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import scan
from .folders import checkpointed
from ..shipping import ship

TRAIN_ROWS = 1500
ROUNDS = 2
#: Words worked on at once, and the bytes of each of them: bounds the tables of the forward pass.
GROUP, SEGMENT = 2048, 128
#: Steps after which the forward probabilities are scaled, so that no long word underflows.
RESCALE = 8
#: Text bytes read at once.
PIECE_BYTES = 1 << 20
FLOOR = 1e-7
START = 1
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True


def vocabulary(path: str | None = None) -> list[bytes]:
    """Single bytes, then the vocabulary's lower-case letter pieces of whatever length."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([b]) for b in range(256)]
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        s = sp.id_to_piece(i)
        bare = s.removeprefix("▁")
        raw = (b"\x01" if bare != s else b"") + bare.encode()
        if bare.isalpha() and bare == bare.lower() and len(raw) > 1:
            pieces.append(raw)
    return list(dict.fromkeys(pieces))


@lru_cache(maxsize=1)
def _trie(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The root's children by byte, a column for each byte, transitions (node, column) -> node with 0 for none, each node's
    piece, and the length of the longest piece."""
    pieces = [bytes.fromhex(x.decode()) for x in joined.split(b",")]
    nodes: list[dict[int, int]] = [{}]
    piece_of = {}
    for k, piece in enumerate(pieces):
        at = 0
        for b in piece:
            if b not in nodes[at]:
                nodes.append({})
                nodes[at][b] = len(nodes) - 1
            at = nodes[at][b]
        piece_of[at] = k
    # only bytes that occur within pieces have columns of their own; the others share one, which leads nowhere
    used = sorted({b for own in nodes[1:] for b in own})
    column = np.zeros(256, np.uint8)
    column[used] = np.arange(1, len(used) + 1)
    step = np.zeros((len(nodes), len(used) + 1), np.int32)
    first = np.zeros(256, np.int32)
    for n, own in enumerate(nodes):
        for b, to in own.items():
            if n:
                step[n, column[b]] = to
            else:
                first[b] = to
    return first, column, step, np.array([piece_of.get(n, len(pieces)) for n in range(len(nodes))], np.int32), max(map(len, pieces))


class Words:
    """Distinct words of a batch, sorted by falling length, with the sums over their segmentations.

    Words are worked on in groups, and a group in segments of ``SEGMENT`` bytes of each word, so that the
    tables are bounded however long a word is.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trie: tuple) -> None:
        """Word w is raw[starts[w] : starts[w] + lengths[w]], with the start mark put before it."""
        self.trie = trie
        self.lengths = lengths + 1
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.buf = np.full(int(self.offsets[-1]), START, np.uint8)
        self.buf[scan.ranges(self.offsets[:-1] + 1, lengths)] = raw[scan.ranges(starts, lengths)]

    def groups(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Slices of words, with the number of words of at least j bytes for each j."""
        for at in range(0, len(self.lengths), GROUP):
            own = slice(at, min(at + GROUP, len(self.lengths)))
            yield own, np.searchsorted(-self.lengths[own], -np.arange(int(self.lengths[at]) + 2), "right")

    def segment(self, own: slice, active: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, int]:
        """ends[-k, c]: the piece of k bytes that ends at column c; each word's column of byte ``at``; the number of
        bytes before it.  A segment has these bytes too, since pieces that end in it may begin there."""
        first, column, step, piece_of, longest = self.trie
        n, before = int(active[at + 1]), min(at, longest - 1)
        start = self.offsets[own][:n] + at - before
        size = np.minimum(self.lengths[own][:n], at + SEGMENT) - at + before
        buf, stop = self.buf[scan.ranges(start, size)], np.cumsum(size)
        ends = np.full((longest, len(buf)), piece_of[0], np.int32)  # the root is no piece
        place, node, limit = np.arange(len(buf)), np.zeros(len(buf), np.int32), np.repeat(stop, size)
        for k in range(longest):
            inside = place + k < limit[place]
            place, node = place[inside], node[inside]
            byte = buf[place + k]
            node = step[node, column[byte]] if k else first[byte]
            place, node = place[node > 0], node[node > 0]
            ends[longest - 1 - k, place + k] = piece_of[node]
        return ends, stop - size + before, before

    def counts(self, weight: np.ndarray, n: int) -> np.ndarray:
        """Occurrences of each of ``n`` pieces at all places; weight: occurrences of each word."""
        out = np.zeros(n)
        for own, active in self.groups():
            for at in range(0, len(active) - 2, SEGMENT):
                ends, col, before = self.segment(own, active, at)
                size = np.diff(np.append(col, ends.shape[1] + before)) - before
                here = scan.ranges(col, size)
                times = np.repeat(weight[own][: len(col)], size)
                for row in ends:
                    out += np.bincount(row[here], times, n)
        return out

    def forward(self, own: slice, active: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """j, alpha and its log scale [word, language] for every j, of the words of at least j bytes: alpha times exp(scale)
        is the probability of the first j bytes; p[piece, language], last row zero."""
        longest, n = self.trie[4], own.stop - own.start
        past = np.zeros((longest + SEGMENT, n, p.shape[1]))  # past[longest - 1] is the alpha before the segment
        past[longest - 1], scale = 1, np.zeros((n, p.shape[1]))
        for at in range(0, len(active) - 2, SEGMENT):
            ends, col, _ = self.segment(own, active, at)
            for i in range(min(SEGMENT, len(active) - 2 - at)):
                j, n = at + i + 1, int(active[at + i + 1])
                k = min(j, longest)
                piece = ends[longest - k :, col[:n] + i]
                now = np.einsum("knl,knl->nl", past[i + longest - k : i + longest, :n], p[piece])
                past[i + longest, :n] = now
                yield j, now, scale[:n]
                if j % RESCALE == 0:
                    n = int(active[j + 1])
                    past[i + 1 : i + longest + 1, :n] /= now[:n]
                    scale[:n] += np.log(now[:n])
            past[:longest] = past[SEGMENT:]

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        """log P(word | language), over all segmentations."""
        out = np.zeros((len(self.lengths), p.shape[1]))
        for own, active in self.groups():
            for j, alpha, scale in self.forward(own, active, p):
                done = int(active[j + 1])
                out[own][done : len(alpha)] = np.log(alpha[done:]) + scale[done:]
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, for one language; weight: occurrences of each word."""
        longest, out = self.trie[4], np.zeros(len(p))
        with np.errstate(divide="ignore"):
            log_p = np.log(p[:, 0])
        for own, active in self.groups():
            size = self.lengths[own] + 1
            base = np.cumsum(size) - size
            log_alpha, uses = np.zeros(int(size.sum())), np.zeros(int(size.sum()))
            for j, alpha, scale in self.forward(own, active, p):
                log_alpha[base[: len(alpha)] + j] = np.log(alpha[:, 0]) + scale[:, 0]
            uses[base + self.lengths[own]] = weight[own]
            for at in reversed(range(0, len(active) - 2, SEGMENT)):
                ends, col, _ = self.segment(own, active, at)
                shares = np.zeros(ends.shape)
                for i in reversed(range(min(SEGMENT, len(active) - 2 - at))):  # uses of place j are whole: give to the starts of pieces that end there
                    j, n = at + i + 1, int(active[at + i + 1])
                    k = min(j, longest)
                    place = base[:n] + j
                    start = place - np.arange(k, 0, -1)[:, None]
                    share = uses[place] * np.exp(log_alpha[start] + log_p[ends[longest - k :, col[:n] + i]] - log_alpha[place])
                    uses[start] += share
                    shares[longest - k :, col[:n] + i] = share
                out += np.bincount(ends.ravel(), shares.ravel(), len(p))
        return out


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and lengths of the letter runs, and the first run of each text."""
    buf, offsets = scan.texts_of(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends = scan.spans(buf, offsets, LETTER)
    return buf, starts, ends - starts, np.searchsorted(starts, offsets)


def _distinct(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct run, by falling length, and for each run the place of its like in that list."""
    one, of = scan.distinct(buf, starts, starts + lengths)
    order = np.argsort(-lengths[one], kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return one[order], back[of]


def _pack(pieces: list[bytes]) -> bytes:
    return b",".join(x.hex().encode() for x in pieces)


def train(docs: DataFrame, pieces: list[bytes], text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and P(piece | language) with a last row of zeros."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull())
    counts = {r["l"]: r["n"] for r in own.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((len(pieces) + 1, 0))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows / counts[k])))])
    chosen = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(5)), F.lit(1 << 30)) < F.element_at(share, F.col(lang)) * (1 << 30)
    place = F.create_map(*[x for k, name in enumerate(langs) for x in (F.lit(name), F.lit(k))])
    sample = checkpointed(own.where(chosen).select(F.element_at(place, F.col(lang)).alias("l"), F.col(text).alias("text")))
    packed, p = _pack(pieces), None
    for _ in range(rounds + 1):
        given = spark.sparkContext.broadcast(p)

        def count(batches: Iterator[pa.RecordBatch], given=given, n=len(pieces)) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            trie, sums = _trie(packed), {}
            for b in scan.pieces_of(batches, "text", PIECE_BYTES):
                for k in pc.unique(b.column("l")).to_pylist():
                    buf, starts, lengths, _ = _runs(b.filter(pc.equal(b.column("l"), k)).column("text"))
                    one, of = _distinct(buf, starts, lengths)
                    if not len(one):
                        continue
                    words, weight = Words(buf, starts[one], lengths[one], trie), np.bincount(of, minlength=len(one))
                    if given.value is None:
                        own = words.counts(weight, n + 1)
                    else:
                        own = words.expected(given.value[:, [k]], weight)
                    sums[k] = sums.get(k, 0) + own[:n]
            for k, own in sums.items():
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_pydict({"l": pa.array(np.full(len(at), k, np.int32)), "p": pa.array(at.astype(np.int32)), "n": pa.array(own[at])})

        table = np.zeros((len(pieces) + 1, len(langs)))
        for r in sample.mapInArrow(count, "l int, p int, n double").groupBy("l", "p").agg(F.sum("n").alias("n")).collect():  # at most pieces x languages
            table[r["p"], r["l"]] = r["n"]
        total = table.sum(0) + 1e-9
        p = (1 - FLOOR * len(pieces)) * table / total + FLOOR
        p[-1] = 0
        p[:-1] /= p[:-1].sum(0)
    return langs, p


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter."""
    buf, offsets = scan.texts_of(pc.utf8_lower(column.cast(pa.large_string())))
    ascii_letter, beyond = (np.concatenate([[0], np.cumsum(inside)]) for inside in ((buf >= 97) & (buf <= 122), buf >= 128))
    has = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for t in np.flatnonzero(~has & (beyond[offsets[1:]] > beyond[offsets[:-1]])):  # only characters beyond ASCII: are any of them letters?
        has[t] = any(c.isalpha() for c in column[int(t)].as_py())
    return has


def scores(column: pa.Array, trie: tuple[np.ndarray, ...], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each text (-1: no letter) and its posterior under equal priors."""
    buf, starts, lengths, first = _runs(column)
    n = len(first) - 1
    best, score = np.full(n, -1), np.zeros(n)
    if not len(starts) or not p.shape[1]:
        return best, score
    one, of = _distinct(buf, starts, lengths)
    own = Words(buf, starts[one], lengths[one], trie).likelihood(p)
    text = np.repeat(np.arange(n), np.diff(first))
    total = np.stack([np.bincount(text, own[of, k], n) for k in range(p.shape[1])], 1)
    has = has_letter(column)
    top = total.max(1, keepdims=True)
    best[has] = total.argmax(1)[has]
    score[has] = (1 / np.exp(total - top).sum(1))[has]
    return best, score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], pieces: list[bytes], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced)."""
    ship(docs.sparkSession)
    langs, p = model
    given, packed = docs.sparkSession.sparkContext.broadcast(p), _pack(pieces)
    kept = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan.pieces_of(batches, text, PIECE_BYTES):
            best, score = scores(b.column(text), _trie(packed), given.value)
            names = pa.array([langs[k] if k >= 0 else "und" for k in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, names, pa.array(score)], [*b.schema.names, "lang_pred", "score"])

    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, pieces: list[bytes] | None = None) -> DataFrame:
    """The documents that have a language; same columns.  Only those without any letter are rejected, also if there is
    nothing to learn languages from."""
    pieces = vocabulary() if pieces is None else pieces
    model = train(docs, pieces)
    if not model[0]:

        def lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in scan.pieces_of(batches, "text", PIECE_BYTES):
                yield b.filter(pa.array(has_letter(b.column("text"))))

        return docs.mapInArrow(lettered, docs.schema)
    names = {c: f"_{i}_{c}" for i, c in enumerate(docs.columns) if c in ("lang_pred", "score")}
    out = predict(docs.withColumnsRenamed(names), model, pieces).where("lang_pred <> 'und'").drop("lang_pred", "score")
    return out.withColumnsRenamed({v: k for k, v in names.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    pieces = vocabulary()
    model = train(docs.where(~held_out), pieces)
    out = predict(docs.select("doc_id", "text"), model, pieces)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
