"""Mentions of the names in a table: all names are looked for in one scan of the texts.

The names, case-folded and distinct, become a trie whose steps are 8 bytes long.  It is held in flat arrays: an edge is
(node, the next 8 bytes) and leads to a node; a name ends in a node with its last 1 to 8 bytes.  A batch of texts is
one buffer.  All places of it start at the root and are looked up together, level by level; only those that are on
the way to a name stay.  Look-ups go through a hash, but an edge is followed only if its node and its bytes are equal, so
nothing rests on the hash alone.  The work on a text is in proportion to its length and its matches, whatever the number of names.

The trie of a lexicon of up to ``MOST_BYTES`` of names (measured first) is broadcast: about 40 bytes for 8 of a name.  A larger
one is dealt into blocks by name, one trie and one scan each.

Offsets are those in the source text, though names are found in the folded one: the folded text of a row that folding
lengthens carries the source place of each of its characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..shipping import ship

MOST_BYTES = 16 << 20
#: Text characters looked at together: bounds a worker's memory.
PIECE = 1 << 20
STEP = 8
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _hash(node: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    h = key ^ (node.astype(np.uint64) * _MULT + np.uint64(seed))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


@dataclass
class Table:
    """(node, key) -> value, sorted by hash, with a bit table in front."""

    seed: int
    hashes: np.ndarray
    node: np.ndarray
    key: np.ndarray
    value: np.ndarray
    bits: np.ndarray

    @staticmethod
    def of(node: np.ndarray, key: np.ndarray, value: np.ndarray) -> Table:
        seed = 1
        while len(np.unique(h := _hash(node, key, seed))) < len(h):  # no two entries share a hash
            seed += 1
        order = np.argsort(h)
        width = max(10, int(np.ceil(np.log2(max(1, len(h)) * 16))))
        bits = np.zeros(1 << min(width, 26), bool)
        bits[h >> np.uint64(64 - min(width, 26))] = True
        return Table(seed, h[order], node[order], key[order], value[order], bits)

    def look(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are there, and their values."""
        h = _hash(node, key, self.seed)
        some = np.flatnonzero(self.bits[h >> np.uint64(64 - (len(self.bits).bit_length() - 1))])
        at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
        ok = (self.hashes[at] == h[some]) & (self.node[at] == node[some]) & (self.key[at] == key[some])
        return some[ok], self.value[at[ok]]


@dataclass
class Trie:
    """The names' edges, and for each number of last bytes the table of the ends with so many."""

    edges: Table | None
    ends: dict[int, Table]
    leads: np.ndarray  # the first two bytes that names of two bytes or more begin with


def _keys(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros beyond the end."""
    wide = np.concatenate([buf, np.zeros(STEP, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for k in range(STEP):
        out = out << np.uint64(8) | wide[k : k + len(buf)]
    return out


def _last(key: np.ndarray, n: int) -> np.ndarray:
    return key >> np.uint64(8 * (STEP - n))


def trie(names: list[bytes]) -> Trie:
    """``names``: distinct and not empty; a name's place is its number."""
    size = np.array([len(n) for n in names], np.int64)
    buf = np.frombuffer(b"".join(names), np.uint8)
    start = np.cumsum(size) - size
    keys, node, made = _keys(buf), np.zeros(len(names), np.int64), 1
    steps, parts = (size - 1) // STEP, []
    for level in range(int(steps.max(initial=0))):
        own = np.flatnonzero(steps > level)
        pair = np.stack([node[own].astype(np.uint64), keys[start[own] + level * STEP]], 1)
        distinct, of = np.unique(pair, axis=0, return_inverse=True)
        node[own] = made + of.ravel()
        parts.append((distinct[:, 0].astype(np.int64), distinct[:, 1], made + np.arange(len(distinct))))
        made += len(distinct)
    edges = Table.of(*[np.concatenate(x) for x in zip(*parts, strict=True)]) if parts else None
    ends, rest = {}, size - steps * STEP
    for n in np.unique(rest).tolist():
        own = np.flatnonzero(rest == n)
        ends[n] = Table.of(node[own], _last(keys[start[own] + steps[own] * STEP], n), own)
    leads = np.zeros(1 << 16, bool)
    two = size > 1
    leads[_last(keys[start[two]], 2).astype(np.int64)] = True
    leads.reshape(256, 256)[buf[start[~two]]] = True  # a name of one byte goes with any second one
    return Trie(edges, ends, leads)


def occurrences(t: Trie, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, name, start, end) of the first place of each name in each text, in bytes."""
    if not len(buf):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    keys = _keys(buf)
    place = np.flatnonzero(t.leads[_last(keys, 2).astype(np.int64)])
    node, depth, found = np.zeros(len(place), np.int64), 0, []
    while len(place):
        key = keys[place + depth]
        for n, table in t.ends.items():
            at, name = table.look(node, _last(key, n))
            found.append((place[at], name, place[at] + depth + n))
        if t.edges is None:
            break
        at, node = t.edges.look(node, key)
        place, depth = place[at], depth + STEP
        inside = place + depth < len(buf)
        place, node = place[inside], node[inside]
    start, name, end = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    text = np.searchsorted(offsets, start, "right") - 1
    whole = end <= offsets[text + 1]  # no name goes on in the next text
    text, name, start, end = text[whole], name[whole], start[whole], end[whole]
    order = np.lexsort((start, name, text))
    text, name, start, end = text[order], name[order], start[order], end[order]
    first = np.r_[True, (text[1:] != text[:-1]) | (name[1:] != name[:-1])] if len(text) else np.zeros(0, bool)
    return text[first], name[first], start[first], end[first]


def fold(text: str, compat: bool = False) -> str:
    """Full case folding; with ``compat``, of the text's composed compatibility form."""
    return text.lower() if text.isascii() else (unicodedata.normalize("NFKC", text) if compat else text).casefold()


def places(text: str, compat: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the folded text, the start and the end of what it comes from."""
    parts = regex.findall(r"[\x00-\x7F](?=[\x00-\x7F]|\Z)|\X", text) if compat else list(text)
    size, made = (np.array([len(x) for x in xs], np.int64) for xs in (parts, [fold(p, compat) for p in parts]))
    end = np.cumsum(size)
    return np.repeat(end - size, made), np.repeat(end, made)


def mentions_in(texts: list[str], t: Trie, compat: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, name, start, end) of first occurrences, in characters of the source texts."""
    folded = [fold(x, compat) for x in texts]
    raw = [x.encode() for x in folded]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    text, name, start, end = occurrences(t, buf, offsets)
    before = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # characters before each byte
    start, end = before[start] - before[offsets[text]], before[end] - before[offsets[text]]
    for k in np.unique(text).tolist():
        if not texts[k].isascii() and (compat or len(folded[k]) != len(texts[k])):  # case folding only ever lengthens
            own = text == k
            first, last = places(texts[k], compat)
            start[own], end[own] = first[start[own]], last[end[own] - 1]
    return text, name, start, end


def dictionary_mentions(chunks: DataFrame, lexicon: DataFrame | list[tuple[str, str, str]], key: str, text: str = "text", compat: bool = False, most: int = MOST_BYTES) -> DataFrame:
    """(key, type, name, alias, start, end): first occurrence of each entry (type, name, alias) in each text, case apart.

    Defined cases: a null or empty alias is found nowhere; a null text holds nothing; equal entries are one, entries of equal folded
    aliases are found at the same place; a match that begins or ends within what one character folds to (ß, a ligature) is that
    whole character; a row is looked at by itself, so rows of equal keys each give their mentions.  ``compat`` folds
    compatibility forms (full width, ligatures) too.
    """
    spark = chunks.sparkSession
    ship(spark)
    if not isinstance(lexicon, DataFrame):
        lexicon = spark.createDataFrame(lexicon, "type string, name string, alias string")
    folded = F.pandas_udf(lambda s: s.map(lambda x: fold(x, compat), na_action="ignore"), StringType())  # as the texts are folded
    entries = lexicon.select("type", "name", "alias").distinct().withColumn("f", folded("alias")).where("f <> ''")
    size = lambda *cs: sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in cs), F.lit(24))
    total = entries.agg(F.sum(size("type", "name", "alias", "f"))).first()[0] or 0
    blocks = max(1, -(-total // most))
    kind = chunks.schema[key].dataType
    hit = StructType([StructField(key, kind), StructField("f", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    out = None
    for b in range(blocks):
        own = entries.where(F.pmod(F.xxhash64("f"), F.lit(blocks)) == b) if blocks > 1 else entries
        names = sorted(r["f"] for r in own.select("f").distinct().collect())  # at most about ``most`` bytes
        given = spark.sparkContext.broadcast((names, trie([n.encode() for n in names])))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            names, t = given.value
            names = pa.array(names, pa.string())
            for batch in batches:
                rows, at = batch.column(1).to_pylist(), 0
                while at < len(rows):
                    to, n = at, 0
                    while to < len(rows) and (to == at or n + len(rows[to] or "") <= PIECE):
                        n, to = n + len(rows[to] or ""), to + 1
                    row, name, start, end = mentions_in([x or "" for x in rows[at:to]], t, compat)
                    keys = batch.column(0).take(pa.array(row + at))
                    yield pa.RecordBatch.from_arrays([keys, names.take(pa.array(name)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], [key, "f", "start", "end"])
                    at = to

        if names:
            found = chunks.select(key, F.col(text).alias("_t")).mapInArrow(run, hit)
            part = found.join(F.broadcast(own), "f").select(key, "type", "name", "alias", "start", "end")  # of the size that was checked
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], StructType([StructField(key, kind), *hit_fields()])) if out is None else out


def hit_fields() -> list[StructField]:
    return [*[StructField(n, StringType()) for n in ("type", "name", "alias")], *[StructField(n, IntegerType()) for n in ("start", "end")]]
