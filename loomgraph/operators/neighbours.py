"""The nearest concept of the same type by cosine, exactly, without comparing all pairs of a type.

Vectors are put to the nearest (by angle) of a few pivots, so concepts fall into clusters (type, length, pivot), each with a radius.  By the
triangle inequality for angles, no member of a cluster is nearer to a query than its angle to the pivot less the radius.  Each
query first looks into the one cluster with the best bound; then into those others whose bound is at least what it has
found.  So nothing is lost, and a cluster is met only by queries that might find something better there.

Clusters are cut into blocks of at most about ``BLOCK`` concepts, and the queries of a cluster into parts of about ``PART``, so a
cluster with a third of all rows is dealt like any other.  A task holds one block and streams the queries; what leaves
it is the best of the block for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

from ..shared import kept
from ..shipping import ship

PIVOTS = 32
#: Lengths of vectors that have pivots of their own; vectors of other lengths are one cluster a type, which is cut into blocks all the same.
LENGTHS = 8
BLOCK, PART = 1 << 14, 1 << 17
#: Scores count as equal that are so after rounding to 6 digits; bounds leave room for that and for the arithmetic.
ROOM = 2e-6
#: Scores held at once.
TILE = 1 << 21


def rounded(x: np.ndarray) -> np.ndarray:
    """To 6 digits, halves away from zero."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6 + 0.0


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of unit vectors."""
    flat = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1.0, 1.0))


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray], every: bool) -> DataFrame:
    """``rows`` (.., n, v) with the number of the nearest pivot and the angle to it; with ``every``, all angles."""
    given = rows.sparkSession.sparkContext.broadcast(pivots)
    kind = rows.select(F.array(F.lit(0.0)).alias("x")).schema["x"].dataType
    more = [StructField("angles", kind)] if every else [StructField("p", IntegerType()), StructField("angle", DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column("n"))
            for n in np.unique(size).tolist():
                part = b.filter(pa.array(size == n))
                own = given.value.get(n)
                angles = _angles(_matrix(part.column("v")), own) if own is not None else np.full((part.num_rows, 1), np.pi)
                if every:
                    added = [pa.array(list(angles), pa.list_(pa.float64()))]
                else:
                    at = angles.argmin(1)
                    added = [pa.array(at.astype(np.int32)), pa.array(angles[np.arange(len(at)), at])]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *[f.name for f in more]])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *more]))


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (cell.., kind, i, v), concepts first: for each query of a cell the largest score, and the smallest concept that has it."""
    cell, held, block, ids = None, [], None, None
    names = ["type", "n", "p", "b", "s"]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for name in [*names, "kind"]:
            codes = np.asarray(batch.column(name).dictionary_encode().indices)
            new[1:] |= codes[1:] != codes[:-1]
        cuts = np.flatnonzero(new)
        for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
            part = batch.slice(s, e - s)
            key = tuple(part.column(n)[0].as_py() for n in names)
            if key != cell:
                cell, held, block = key, [], None
            if part.column("kind")[0].as_py() == 0:
                held.append(part)
                continue
            if not held and block is None:
                continue
            if block is None:
                whole = pa.concat_batches(held)
                block, ids, held = _matrix(whole.column("v")), whole.column("i"), []  # sorted by id
            q, v = part.column("i"), _matrix(part.column("v"))
            own = np.asarray(ids.to_pylist(), object)
            for at in range(0, len(q), max(1, TILE // max(1, len(ids)))):
                to = min(len(q), at + max(1, TILE // max(1, len(ids))))
                score = rounded(np.clip(v[at:to] @ block.T, -1.0, 1.0))
                mine = np.asarray(q.slice(at, to - at).to_pylist(), object)
                score[mine[:, None] == own[None, :]] = -2.0
                best = score.argmax(1)  # the first of equal scores: the smallest id
                found = score[np.arange(len(best)), best]
                some = found >= -1.0
                yield pa.RecordBatch.from_arrays([q.slice(at, to - at).filter(pa.array(some)), ids.take(pa.array(best[some])), pa.array(found[some])], ["q", "c", "score"])


def _met(probes: DataFrame, concepts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(q, c, score): the best of each block for the queries sent to its cluster.  probes (q, type, n, p, v)."""
    cluster = ["type", "n", "p"]
    parts = probes.groupBy(*cluster).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    cut = clusters.select(*cluster, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")).join(parts, cluster)
    dealt = lambda c, k, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.col(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = concepts.join(cut, cluster).withColumn("b", dealt("c", "blocks", 1)).withColumn("s", each("parts"))
    ask = probes.join(cut, cluster).withColumn("s", dealt("q", "parts", 2)).withColumn("b", each("blocks"))
    both = own.select(*cluster, "b", "s", F.lit(0).alias("kind"), F.col("c").alias("i"), "v").unionByName(ask.select(*cluster, "b", "s", F.lit(1).alias("kind"), F.col("q").alias("i"), "v"))
    cell = [*cluster, "b", "s"]
    found = both.repartition(*cell).sortWithinPartitions(*cell, "kind", "i")
    schema = StructType([StructField("q", probes.schema["q"].dataType), StructField("c", concepts.schema["c"].dataType), StructField("score", DoubleType())])
    return found.mapInArrow(_best, schema)


def _largest(found: DataFrame) -> DataFrame:
    """(q, c, score): the largest score, of equal ones the smallest c; combines map-side."""
    return found.groupBy("q").agg(F.min(F.struct((-F.col("score")).alias("s"), "c")).alias("b")).select("q", F.col("b.c").alias("c"), (-F.col("b.s")).alias("score"))


def nearest(queries: DataFrame, concepts: DataFrame, threshold: float = -1.0, pivots: int = PIVOTS, work: list | None = None) -> DataFrame:
    """(q, nearest, score): of the concepts (c, type, v) of a query's type, other than itself, the one with the largest cosine, rounded
    to 6 digits; the smaller c on ties.  ``queries`` (q, type, v).

    Defined cases: the cosine is 0 for vectors of different lengths, and for null, empty or zero ones, or those with a null or
    non-finite component; a null type meets nothing; a query without another concept of its type, or none at ``threshold``,
    has no row.  ``work``: takes the two tables of (q, type, n, p) that say which clusters were looked into.
    """
    spark = queries.sparkSession
    ship(spark)
    length = F.coalesce(F.size("v"), F.lit(0))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    proper = F.coalesce((length > 0) & (square > 0) & (square < float("inf")), F.lit(False))
    usable = lambda df, k: df.where("type is not null").select(k, "type", F.when(length > 0, length).otherwise(0).alias("n"), "v", proper.alias("proper"))
    c, q = usable(concepts, "c"), usable(queries, "q")
    plain_c, plain_q = c.where("proper").drop("proper"), q.where("proper").drop("proper")

    # pivots: vectors with the smallest hashes, a bounded number for each of a bounded number of lengths
    first = plain_c.groupBy("n").agg(F.count("*").alias("size"), *[F.min(F.struct(F.xxhash64("c", F.lit(k)).alias("h"), "v")).alias(f"v{k}") for k in range(pivots)])
    table = {}
    for r in first.orderBy(F.desc("size"), "n").limit(LENGTHS).collect():
        own = np.unique(np.array([[float(x) for x in r[f"v{k}"]["v"]] for k in range(pivots)]), axis=0)
        table[r["n"]] = own / np.sqrt((own * own).sum(1, keepdims=True))

    placed = kept(_placed(plain_c, table, False))
    clusters = kept(placed.groupBy("type", "n", "p").agg(F.count("*").alias("size"), F.max("angle").alias("radius")))
    asked = _placed(plain_q, table, True)
    # what a query can find in each cluster of its type at the most
    near = asked.join(clusters, ["type", "n"]).withColumn("bound", F.cos(F.greatest(F.get("angles", "p") - F.col("radius"), F.lit(0.0))) + ROOM)
    by = W.partitionBy("q").orderBy(F.desc("bound"), "p")
    near = kept(near.select("q", "type", "n", "p", "bound", F.row_number().over(by).alias("r")))
    vectors = plain_q.select("q", "v")
    home = near.where("r = 1").select("q", "type", "n", "p")
    found = kept(_largest(_met(home.join(vectors, "q"), placed, clusters)))
    rest = near.where("r > 1").join(found.select("q", "score"), "q", "left").where("score is null or bound >= score").select("q", "type", "n", "p")
    more = _met(rest.join(vectors, "q"), placed, clusters)
    if work is not None:
        work += [home, rest]

    # scores of 0 without a comparison: the smallest such concepts of each type, by length; two, since one may be the query itself
    none = q.join(_smallest(c).select(F.col("type").alias("_t"), F.col("n").alias("_n"), F.col("proper").alias("_proper"), "cs"), F.col("type") == F.col("_t"))
    none = none.where(~F.col("proper") | ~F.col("_proper") | (F.col("n") != F.col("_n"))).select("q", F.explode("cs").alias("c"), F.lit(0.0).alias("score")).where("q <> c")
    best = _largest(found.unionByName(more).unionByName(none))
    return best.select("q", F.col("c").alias("nearest"), "score").where(F.col("score") >= threshold)


def _smallest(c: DataFrame) -> DataFrame:
    """(type, n, proper, cs): the two smallest ids of each group, by two minima that combine map-side."""
    by = ["type", "n", "proper"]
    one = c.groupBy(*by).agg(F.min("c").alias("a"))
    two = c.join(one, by).where("c > a").groupBy(*by).agg(F.min("c").alias("b"))
    return one.join(two, by, "left").select(*by, F.filter(F.array("a", "b"), lambda x: x.isNotNull()).alias("cs"))
