"""Near-duplicate documents: b-bit MinHash signatures, a multi-index Hamming join, exact confirmation.

1. One pass gives each document the size, a 128-bit fingerprint and a signature of its set of
   word 5-grams.  Words are hashed by a cryptographic digest.  Documents with equal sets are one class; only its smallest key goes on, so a
   large group of copies costs one row (combined map-side, before any shuffle).
2. The first INDEXED values of a signature are cut into CHUNKS.  Two signatures that differ in at most
   ``2 * CHUNKS - 1`` places differ in at most one place of some chunk (pigeonhole).  So each
   chunk gives a key for each of its places left out, and all such pairs share a key.  At
   a similarity of 0.75 a pair differs in more places with probability below 1e-6.
3. Within a key, signatures are compared over all their values (MOST_FAR; same probability).  Members near
   the key's smallest member form a canopy named by it; a member that is not near it joins
   the canopy together with each partner it is near.  Every near pair is thus in a canopy.
   Keys with more than TILE members are cut into tiles and compared tile by tile.
4. The texts of canopy members, and only these, are read again.  A canopy of at most SET_TILE members is one
   group: if all are confirmed on the full sets against its smallest member, that is its star of links, else
   all its pairs are compared.  The members of a larger canopy are first confirmed, in tiles, against its
   smallest member and PIVOTS more, so that a group of copies of one text costs a star.  Those that are
   then in the component of the smallest member need not be compared with each other; all others
   meet every member of their canopy in pairs of tiles.  No link between different components is
   lost, and no group is expanded into rows of pairs.
5. Components are found by contraction (components.py).

A group of n different near copies none of which is 0.75 similar to a pivot still costs n * n / SET_TILE sets.

Nothing is collected to the driver; the parts that are used twice are checkpointed.

Defined cases: a null or empty text has no shingles and is linked with nothing; a document of
fewer words than five has one shingle, its whole sequence; rows that share a key are one
document, linked if any of its texts is; a row with a null key is linked with nothing, has a null
component and is kept; an empty table gives an empty result; other columns are ignored, whatever their
names (``deduplicated`` keeps them).  Ties do not arise: components and pivots are named by the smallest key.
Very long texts are one row of a batch of their own: memory is about 40 bytes a byte of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, scan
from .components import components, dealt_join, salts
from .folders import checkpointed
from .native_spans import fresh
from ..shipping import ship

INDEXED = 64
CHUNKS = 18
MOST_FAR = 58
TILE = 4096
SET_TILE = 256
PIVOTS = 4
WHOLE = -1
#: A canopy's members are dealt into so many parts at least.
LEAST_SALTS = 16
#: Places (about 80 bytes each) of the second round, of large canopies alone, that are broadcast to the texts; more are joined.
FEW_PLACES = 1 << 15
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A set of so many shingles at most is similar to none but its equals (three of four are the smallest others): it is settled
#: by its fingerprint, so that the 64 bits of a single shingle never decide alone.
ALONE = 2


def chunk_places(indexed: int = INDEXED, chunks: int = CHUNKS) -> list[list[int]]:
    """The places of each key: a chunk without one of its places."""
    out = []
    for part in np.array_split(np.arange(indexed), chunks):
        out += [[int(x) for x in part if x != left] for left in part]
    return out


def described(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(d, n, f1, f2, sig) of every row: key, set size, fingerprint, signature (null for an empty set)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan.pieces_of(batches, "t"):
            value, other, first = minhash.described_sets(b.column("t"))
            n, fp = np.diff(first), minhash.fingerprints(value, other, first).view(np.int64)
            some = np.flatnonzero(n)
            sig = np.full(len(n), None, object)
            if len(some):
                own = minhash.signatures(value, np.append(first[:-1][some], first[-1]))
                packed = np.hstack([own[:, :INDEXED].astype("<u2").view(np.uint8), own[:, INDEXED:].astype(np.uint8)])
                sig[some] = [x.tobytes() for x in packed]
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(n), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(sig, pa.binary())], ["d", "n", "f1", "f2", "sig"])

    return docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, "d long, n long, f1 long, f2 long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """One row of bytes for each signature."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = chunk_places()
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.ascontiguousarray(_matrix(b.column("sig"))[:, : 2 * INDEXED]).view("<u2").astype(np.uint64)
        for salt, own in enumerate(places):
            h = np.full(len(sig), salt + 1, np.uint64)
            for p in own:
                h = scan.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, p])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("rep")], ["key", "rep"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: those whose key has more than one, with the tile they fall into."""
    last, seen, held = None, 0, None
    for b in batches:
        key, rep = np.asarray(b.column(0)), np.asarray(b.column(1))
        if not len(key):
            continue
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        same = last is not None and key[0] == last
        place = np.arange(len(key)) - np.repeat(start, size)
        if same:
            place[: size[0]] += seen
        many = np.repeat(size > 1, size)
        if same:
            many[: size[0]] = True
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([held]), pa.array([0], pa.int32())], ["key", "rep", "tile"])
        seen = int(size[-1]) + (seen if same and len(start) == 1 else 0)
        held = int(rep[-1]) if seen == 1 else None
        last = int(key[-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(rep[many]), pa.array((place[many] // TILE).astype(np.int32))], ["key", "rep", "tile"])


def grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches, sorted by their first ``by`` columns, joined so that no group is cut; and where groups start."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        whole = b if rest is None else pa.concat_batches([rest, b])
        new = np.zeros(whole.num_rows, bool)
        new[0] = True
        for c in range(by):
            x = np.asarray(whole.column(c))
            new[1:] |= x[1:] != x[:-1]
        start = np.flatnonzero(new)
        rest = whole.slice(start[-1])
        if start[-1]:
            yield whole.slice(0, start[-1]), start[:-1]
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _canopies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, rep, sig) sorted by group: (canopy, member) for every near pair of a group."""
    for b, start in grouped(batches, 3):
        rep, sig = np.asarray(b.column("rep")), _matrix(b.column("sig"))
        sig = np.hstack([sig[:, : 2 * INDEXED : 2], sig[:, 2 * INDEXED :]])
        size = np.diff(np.r_[start, len(rep)])
        two = start[size == 2]
        ok = two[((sig[two] != sig[two + 1]).sum(1) <= MOST_FAR) & (rep[two] != rep[two + 1])]
        first = np.minimum(rep[ok], rep[ok + 1])
        canopy, member = [np.repeat(first, 2)], [np.stack([rep[ok], rep[ok + 1]], 1).ravel()]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own, where = np.unique(rep[s : s + n], return_index=True)
            x = sig[s : s + n][where]
            near = (x != x[0]).sum(1) <= MOST_FAR
            join = near.copy() if near.sum() > 1 else np.zeros(len(own), bool)
            far = np.flatnonzero(~near)
            for at in range(0, len(far), 64):
                some = far[at : at + 64]
                for lo in range(0, len(own), 1024):
                    close = (x[some][:, None] != x[None, lo : lo + 1024]).sum(2) <= MOST_FAR
                    inside = (some >= lo) & (some < lo + close.shape[1])
                    close[np.flatnonzero(inside), some[inside] - lo] = False
                    join[some] |= close.any(1)
                    join[lo : lo + 1024] |= close.any(0)
            canopy.append(np.full(int(join.sum()), own[0]))
            member.append(own[join])
        pairs = np.unique(np.stack([np.concatenate(canopy), np.concatenate(member)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["c", "x"])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, t, places): the set of each text, once for each group (c, i, j) of its places."""
    names = ["c", "i", "j", "later", "x", "s"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    for b in scan.pieces_of(batches, "t", 1 << 20):
        value, first = minhash.shingle_sets(b.column("t"))
        rows: list[tuple] = []
        held = 0
        for k, (doc, places) in enumerate(zip(b.column("x").to_pylist(), b.column("places").to_pylist(), strict=True)):
            raw = value[first[k] : first[k + 1]].tobytes()
            for p in places:
                for i, j, lead in _groups(p, doc):
                    rows.append((p["c"], i, j, not lead, doc, raw))
                    held += len(raw)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _groups(p: dict, doc: int) -> Iterator[tuple[int, int, bool]]:
    """The groups (i, j) of one place, and whether the document is what the group's others are compared with.

    A place of a star (``left`` is -1): pivot k meets the members in tiles (k, tile); a canopy of one tile is group WHOLE.  Else: tiles 0 .. left - 1
    hold the members that are left over, tiles left .. tiles - 1 the settled ones; only pairs of tiles with a left-over one meet.
    """
    own, tiles, left = p["tile"], p["tiles"], p["left"]
    if left < 0:
        for k, pivot in enumerate(p["pivots"]):
            if tiles == 1:
                yield WHOLE, 0, pivot == doc
            elif pivot == doc:
                for i in range(tiles):
                    yield k, i, True
            else:
                yield k, own, False
    elif own < left:
        for other in range(tiles):
            yield min(own, other), max(own, other), False
    else:
        for other in range(left):
            yield other, own, False


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b), rows sorted by group and with the pivot's sets in front: those of each pivot with the others of its
    tile; of a WHOLE canopy a spanning forest of all its links."""
    group, pivot, leads, held, star = None, None, [], [], True
    for b in batches:
        links: list[tuple[int, int]] = []
        cols = [b.column(k).to_pylist() for k in range(5)]
        for c, i, j, later, x, s in zip(*cols, b.column(5), strict=True):
            own = np.frombuffer(s.as_py(), np.uint64)
            if group != (c, i, j):
                links += _whole(held, star)
                group, pivot, leads, held, star = (c, i, j), None, [], [], True
            near = False
            if not later:  # a key with several texts has several sets
                pivot = x
                leads.append(own)
            elif any(_similar(lead, own) for lead in leads):
                near = True
                links.append((pivot, x))
            if i == WHOLE:
                star &= near or not later
                held.append((x, own))
        yield _link_batch(links)
    yield _link_batch(_whole(held, star))


def _whole(held: list[tuple[int, np.ndarray]], star: bool) -> list[tuple[int, int]]:
    """The links of a canopy's sets, unless they are a star, whose links are known."""
    return [] if star else [(held[p][0], held[q][0]) for p, q in forest([s for _, s in held])]


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets (sorted, distinct hashes), by their places."""
    g = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if g == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if both and 100 * both >= PERCENT * (size.sum() - both) else []
    value, owner = np.concatenate(sets), np.repeat(np.arange(g), size)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    new = np.r_[True, value[1:] != value[:-1]] if len(value) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1 if len(value) else new
    owner, column = owner[shared], column[shared]
    both = np.zeros((g, g), np.float32)
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        width = 4096
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            m = np.zeros((g, width), np.float32)
            m[owner[lo:hi], column[lo:hi] - k * width] = 1
            both += m @ m.T
    linked = (both > 0) & (100 * both >= PERCENT * (size[:, None] + size[None] - both))
    np.fill_diagonal(linked, False)
    out, free = [], np.ones(g, bool)
    for root in range(g):
        if not free[root]:
            continue
        free[root], front = False, [root]
        while front:
            at = front.pop()
            new_ones = np.flatnonzero(linked[at] & free)
            free[new_ones] = False
            out += [(at, int(v)) for v in new_ones]
            front += new_ones.tolist()
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, start in grouped(batches, 3):
        x, raw = np.asarray(b.column("x")), b.column("s")
        left, right = [], []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), b.num_rows], strict=True):
            for p, q in forest([np.frombuffer(raw[k].as_py(), np.uint64) for k in range(s, e)]):
                left.append(x[s + p])
                right.append(x[s + q])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def candidates(reps: DataFrame) -> DataFrame:
    """Canopies (c, x), from rows (rep, sig) with a row for each class."""
    keys = reps.select("rep", "sig").mapInArrow(_keys, "key long, rep long")
    shared = checkpointed(keys.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_shared, "key long, rep long, tile int"))
    tiles = shared.where("tile > 0").groupBy("key").agg((F.max("tile") + 1).alias("tiles"))
    rows = shared.join(tiles, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    # a row of a tile meets every tile of its key; the usual key has one
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("key", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "rep")
    given = rows.join(reps.select("rep", "sig"), "rep").select("key", "i", "j", "rep", "sig")
    return given.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(_canopies, "c long, x long").distinct()


_PLACE = "struct<c:bigint,tile:int,tiles:int,left:int,pivots:array<bigint>>"


def _read_sets(docs: DataFrame, places: DataFrame, few: int = 0) -> DataFrame | None:
    """(c, i, j, later, x, s): the sets of the texts at their places; docs (x, t), places (x, place), which are broadcast if
    they are no more than ``few``; None if there are none."""
    places = checkpointed(places)
    n = places.count()
    by = places.groupBy("x").agg(F.collect_list("place").alias("places"))
    if n <= few:
        by = F.broadcast(by)
    return docs.join(by, "x").mapInArrow(_dealt, "c long, i int, j int, later boolean, x long, s binary") if n else None


def _tile(size: Column) -> Column:
    return F.ceil(size / SET_TILE).cast("int")


def star_links(docs: DataFrame, canopies: DataFrame, parts: int) -> DataFrame | None:
    """Confirmed links of each canopy's members with its pivots; None if there are no canopies."""
    salted = [F.min(F.struct(F.xxhash64("x", F.lit(k)).alias("h"), "x")).alias(f"p{k}") for k in range(1, PIVOTS + 1)]
    sizes = canopies.groupBy("c").agg(F.count("*").alias("n"), F.min("x").alias("head"), *salted).withColumn("tiles", _tile(F.col("n")))
    more = F.array_except(F.array_distinct(F.array(*[F.col(f"p{k}.x") for k in range(1, PIVOTS + 1)])), F.array("head"))
    pivots = F.when(F.col("tiles") > 1, F.concat(F.array("head"), more)).otherwise(F.array("head"))
    dealt = dealt_join(canopies, sizes.select("c", "tiles", pivots.alias("pivots")), ["c"], parts)
    place = F.struct("c", F.pmod(F.xxhash64("x"), "tiles").cast("int").alias("tile"), "tiles", F.lit(-1).alias("left"), "pivots").cast(_PLACE)
    sets = _read_sets(docs, dealt.select("x", place.alias("place")))
    return sets.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "later", "x").mapInArrow(_stars, "a long, b long") if sets else None


def rest_links(docs: DataFrame, canopies: DataFrame, component: DataFrame, parts: int) -> DataFrame | None:
    """Links of the members of canopies of several tiles that are not in the component of their canopy's smallest member,
    with all others of the canopy; None if there are no such members."""
    comp = component.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    own = canopies.join(comp, F.col("x") == F.col("_n"), "left").select("c", "x", F.coalesce("_c", "x").alias("k"))
    heads = own.groupBy("c").agg(F.min(F.struct("x", "k")).alias("h"))
    # the smallest member has met all others
    own = dealt_join(own, heads, ["c"], parts).where("x <> h.x").withColumn("settled", F.col("k") == F.col("h.k"))
    sizes = own.groupBy("c").agg(F.count_if(~F.col("settled")).alias("free"), F.count("*").alias("n")).where(f"free > 0 and n >= {SET_TILE}")  # smaller ones have been compared whole
    sizes = sizes.select("c", _tile(F.col("free")).alias("left"), (_tile(F.col("free")) + _tile(F.col("n") - F.col("free"))).alias("tiles"))
    dealt = dealt_join(own.select("c", "x", "settled"), sizes, ["c"], parts)
    at = F.xxhash64("x")
    tile = F.when(F.col("settled"), F.col("left") + F.pmod(at, F.greatest(F.col("tiles") - F.col("left"), F.lit(1)))).otherwise(F.pmod(at, "left"))
    place = F.struct("c", tile.cast("int").alias("tile"), "tiles", "left", F.array().cast("array<bigint>").alias("pivots")).cast(_PLACE)
    sets = _read_sets(docs, dealt.select("x", place.alias("place")), FEW_PLACES)
    return sets.select("c", "i", "j", "x", "s").repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "x").mapInArrow(_links, "a long, b long") if sets else None


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    base = checkpointed(described(docs, text, key))
    some = base.where("n > 0 and d is not null")
    reps = checkpointed(some.groupBy("f1", "f2", "n").agg(F.min(F.struct("d", "sig")).alias("m")).select("f1", "f2", "n", F.col("m.d").alias("rep"), F.col("m.sig").alias("sig")))
    canopies = checkpointed(candidates(reps.where(f"n > {ALONE}")))
    texts = docs.select(F.col(key).cast("long").alias("x"), F.col(text).alias("t"))
    parts = max(LEAST_SALTS, salts(canopies.count()))
    star = star_links(texts, canopies, parts)
    found = spark.createDataFrame([], "a long, b long") if star is None else checkpointed(star)
    largest = canopies.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    rest = rest_links(texts, canopies, components(found), parts) if largest > SET_TILE else None
    if rest is not None:
        found = found.unionByName(rest)
    # rows that share a key are one document: its classes are linked
    multi = some.groupBy("d").agg(F.count("*").alias("k")).where("k > 1").select("d")
    same = some.join(multi, "d").join(reps.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"]).select(F.col("d").alias("a"), F.col("rep").alias("b"))
    comp = components(found.unionByName(same))
    classes = reps.select("f1", "f2", "n", "rep").join(comp, reps["rep"] == comp["node"], "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    out = dealt_join(base.select("d", "n", "f1", "f2"), classes, ["f1", "f2", "n"], salts(base.count()), "left")
    out = out.withColumn("component_id", F.when(F.col("d").isNotNull(), F.coalesce("component", "d")))
    return out.select(F.col("d").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("d").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near duplicates: of its document with the smallest key.  Same columns.

    Of several rows with that key, one stays, the first by text (null first) and then by the other columns, so rows that
    remain equal are equal throughout; rows with a null key all stay.
    """
    name = fresh(docs, "_kept")
    kept = near_duplicates(docs, text, key).where(F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias(name)).distinct()
    plain = lambda f: not any(k in f.dataType.simpleString() for k in ("map<", "variant", "interval"))
    fields = sorted((f for f in docs.schema.fields if f.name != key), key=lambda f: (f.name != text, not plain(f)))
    rest = [F.col(f"`{f.name}`") if plain(f) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in fields]
    row, order = F.struct(*[F.col(f"`{f.name}`") for f in fields]), F.struct(*[c.alias(f"r{k}") for k, c in enumerate(rest)])
    first = F.min(row) if all(plain(f) for f in fields) else F.min_by(row, order)
    # reduced before the shuffle, so that a key with very many rows is one row a task
    one = docs.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias(name)).agg(first.alias("row"))
    one = one.join(kept, name, "left_semi").select(*[F.col(name).alias(c) if c == key else F.col("row")[c].alias(c) for c in docs.columns])
    return one.unionByName(docs.where(F.col(f"`{key}`").isNull()))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS d, b AS r FROM e UNION SELECT reach.d, e.b FROM reach JOIN e ON e.a = reach.r),
c AS (SELECT d, min(r) AS r FROM reach GROUP BY d)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.r, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.r, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.d = w.doc_id
"""
