"""Hard negatives for anchors, from integer scores that are sorted whole.

A row's score is its integer inner product with the anchor; higher scores come first, then smaller ids.  An
anchor's positives are its best ``positives`` other rows of the same label.  For each positive, the negatives are the
first ``k`` rows of other labels whose score lies between ``low`` and ``high`` per cent of the positive's.

The work is a grid.  Anchors are dealt into blocks of at most about ``ANCHORS``, rows into blocks of at most about ``ROWS``, and a cell is one of
each; a row is sent to each block of anchors.  A task reads a cell's anchors, then streams its rows in batches, sorted by
id.  For a batch, all scores of an anchor are computed and lexsorted by (score, id); the upper limit of each positive
is found by binary search, and the next ``k`` entries of other labels are read unless they are below the lower limit.  What a
cell keeps for an anchor is the best k for each positive, so the lists of the cells are merged by a rank over ``k * cells`` rows.
The positives are found first, in the same grid, among the rows of the anchor's label only.

Scores are exact: components become integers, and the products run in float32 or float64 only where the norms prove (by
Cauchy and Schwarz) that every partial sum is an integer that the type holds, else in 64-bit or unbounded integers.

Defined cases: rows with a null id, label or vector, or any null or non-finite component, take no part; of several
rows with one id, the first by label, then by vector, stays; a shorter vector counts as filled up with zeros; ties go to the smaller id; an
anchor without positives, and a positive without negatives, have no rows; positives of equal score have equal
negatives; an empty table gives an empty result; other columns are ignored whatever their names.  A score that does not fit
in 64 bits raises an error.  Nothing is collected but two counts; the rows are checkpointed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .folders import checkpointed
from ..shipping import ship

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Anchors and rows of a cell, about; a table of few rows is cut into more cells, so that all cores work.
ANCHORS, ROWS, LEAST_ROWS = 1 << 16, 1 << 20, 1 << 11
#: Scores held at once.
TILE = 1 << 21
SCALE = 256


class Cell:
    """The anchors of a cell and the best entries found for them so far: a row of ``width`` lists of ``depth`` for each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, width: int, depth: int) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.score = np.zeros((len(ids), width, depth), np.int64)
        self.id = np.zeros((len(ids), width, depth), np.int64)
        self.has = np.zeros((len(ids), width, depth), bool)

    def merge(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, has: np.ndarray) -> None:
        """Takes new entries of the anchors ``at``; every list keeps its first ``depth``."""
        depth = self.score.shape[2]
        score, ids, has = (np.concatenate([own[at], new], 2) for own, new in ((self.score, score), (self.id, ids), (self.has, has)))
        first = np.lexsort((ids, -score, ~has), axis=-1)[..., :depth]
        self.score[at], self.id[at], self.has[at] = (np.take_along_axis(x, first, 2) for x in (score, ids, has))

    def found(self) -> pa.RecordBatch:
        a, w, d = np.nonzero(self.has)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(w.astype(np.int32)), pa.array(self.score[a, w, d]), pa.array(self.id[a, w, d])], ["a", "w", "s", "i"])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of two integer matrices (held as float64, or as objects)."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.dtype != object and b.dtype != object:
        most = np.sqrt((a * a).sum(1).max() * 1.001) * np.sqrt((b * b).sum(1).max() * 1.001)
        if most < 2**23:
            return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
        if most < 2**52:
            return (a @ b.T).astype(np.int64)
        if most < 2**62 and max(np.abs(a).max(), np.abs(b).max()) < 2**62:
            return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    return (whole(a) @ whole(b).T).astype(np.int64)  # raises an error beyond 64 bits


def ordered(score: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's places by falling score, then by place; with the sorted scores, and how many of them are not dropped."""
    n = score.shape[1]
    top, low = int(score.max()), int(score.min())
    if (top - low + 2) * n < 2**62:  # score and place as one number: one sort is the lexsort
        key = (top - score) * n + np.arange(n)
        key[drop] = (top - low + 1) * n
        key.sort(axis=1)
        return key % n, top - key // n, n - drop.sum(1)
    place = np.lexsort((np.broadcast_to(np.arange(n), score.shape), -score, drop), axis=-1)
    return place, np.take_along_axis(score, place, 1), n - drop.sum(1)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors as integers, a row each; shorter ones are filled up with zeros."""
    sizes = np.asarray(column.value_lengths()) if len(column) else np.zeros(0, int)
    flat = np.floor(np.asarray(column.flatten()).astype(np.float64) * SCALE)
    if not np.isfinite(flat).all():
        raise ValueError("a component is too large for a score of 64 bits")
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, max(0, width - a.shape[1]))))


def _cells(batches: Iterator[pa.RecordBatch], open_cell: Callable[[pa.RecordBatch], Cell], work: Callable[[Cell, np.ndarray, np.ndarray, np.ndarray], None]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (cell, anchors first, id): what each cell has found when its rows end."""
    at, cell, held = None, None, []
    for b in batches:
        key, row = np.asarray(b.column("cell")), np.asarray(b.column("kind"))
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (row[1:] != row[:-1])) + 1
        for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(key)].tolist(), strict=True):
            if s == e:
                continue
            if key[s] != at:
                if cell is not None:
                    yield cell.found()
                at, cell, held = key[s], None, []
            part = b.slice(s, e - s)
            if row[s] == 0:
                held.append(part)
                continue
            if cell is None:
                if not held:
                    continue
                cell, held = open_cell(pa.concat_batches(held)), []
            ids, labels, vectors = np.asarray(part.column("i")), np.asarray(part.column("l")), _matrix(part.column("v"))
            width = max(vectors.shape[1], cell.vectors.shape[1])
            cell.vectors = _wide(cell.vectors, width)
            work(cell, ids, labels, _wide(vectors, width))
    if cell is not None:
        yield cell.found()


def _tiles(which: np.ndarray, n: int) -> Iterator[np.ndarray]:
    step = max(1, TILE // max(1, n))
    for at in range(0, len(which), step):
        yield which[at : at + step]


def _positives(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """(a, 0, score, id): the best rows of the anchor's own label, in each cell."""

    def work(cell: Cell, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for label in np.unique(labels):
            own, mine = np.flatnonzero(labels == label), np.flatnonzero(cell.labels == label)
            for at in _tiles(mine, len(own)):
                score = scores(cell.vectors[at], vectors[own])
                place, best, n = ordered(score, cell.ids[at][:, None] == ids[own])
                place, best = place[:, :depth], best[:, :depth]
                cell.merge(at, best[:, None], ids[own][place][:, None], (np.arange(place.shape[1]) < n[:, None])[:, None])

    yield from _cells(batches, lambda b: Cell(np.asarray(b.column("i")), np.asarray(b.column("l")), _matrix(b.column("v")), 1, depth), work)


def _negatives(batches: Iterator[pa.RecordBatch], positives: int, k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """(a, number of the positive, score, id): the first rows of other labels within the positive's limits, in each cell."""
    lower: list[np.ndarray] = []
    upper: list[np.ndarray] = []

    def open_cell(b: pa.RecordBatch) -> Cell:
        given = [x or [] for x in b.column("p").to_pylist()]
        # the limits as whole numbers: low * p <= 100 * s <= high * p
        lower[:] = [np.array([-((-low * p) // 100) for p in own], object) for own in given]
        upper[:] = [np.array([(high * p) // 100 for p in own], object) for own in given]
        return Cell(np.asarray(b.column("i")), np.asarray(b.column("l")), _matrix(b.column("v")), positives, k)

    def work(cell: Cell, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for at in _tiles(np.arange(len(cell.ids)), len(ids)):
            place, best, n = ordered(scores(cell.vectors[at], vectors), cell.labels[at][:, None] == labels)
            score, found = np.zeros((2, len(at), positives, k), np.int64)
            has = np.zeros((len(at), positives, k), bool)
            for r, a in enumerate(at.tolist()):
                falling = -best[r, : n[r]]
                first = np.searchsorted(falling, np.array([-u for u in upper[a]], np.int64), "left")
                last = np.searchsorted(falling, np.array([-u for u in lower[a]], np.int64), "right")
                for p, (s, e) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
                    if (m := min(k, e - s)) > 0:
                        score[r, p, :m], found[r, p, :m], has[r, p, :m] = best[r, s : s + m], ids[place[r, s : s + m]], True
            cell.merge(at, score, found, has)

    yield from _cells(batches, open_cell, work)


def _better(*by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("s"), "i"))


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` says of a row whether it is one."""
    spark = rows.sparkSession
    ship(spark)
    given = rows.select(F.col(key).cast("long").alias("i"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("l"), F.col(vector).alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = given.where(F.col("i").isNotNull() & F.col("l").isNotNull() & F.col("v").isNotNull() & whole)
    one = given.groupBy("i").agg(F.min(F.struct("l", "v", "is_anchor")).alias("r")).select("i", "r.l", "r.v", "r.is_anchor")
    one = checkpointed(one)
    n, n_anchors = one.agg(F.count("*"), F.count_if("is_anchor")).first()
    blocks = max(1, -(-n_anchors // ANCHORS))
    cuts = max(-(-n // ROWS), min(-(-n // LEAST_ROWS), 2 * spark.sparkContext.defaultParallelism), 1)

    def grid(anchors: DataFrame, run: Callable) -> DataFrame:
        at = lambda parts, salt: F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(parts))
        each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
        own = anchors.withColumn("r", each(cuts)).withColumn("b", at(blocks, 1)).withColumn("kind", F.lit(0))
        more = one.withColumn("b", each(blocks)).withColumn("r", at(cuts, 2)).withColumn("kind", F.lit(1))
        if "p" in anchors.columns:
            more = more.withColumn("p", F.lit(None).cast("array<long>"))
        names = [c for c in ("i", "l", "v", "p") if c in anchors.columns]
        both = own.select("b", "r", "kind", *names).unionByName(more.select("b", "r", "kind", *names)).withColumn("cell", F.col("b") * cuts + F.col("r"))
        dealt = both.repartitionById(blocks * cuts, F.col("cell").cast("int")).sortWithinPartitions("cell", "kind", "i")
        return dealt.select("cell", "kind", *names).mapInArrow(run, "a long, w int, s long, i long")

    anchors = one.where("is_anchor")
    best = grid(anchors, lambda batches: _positives(batches, positives)).withColumn("k", _better("a")).where(F.col("k") <= positives)
    best = checkpointed(best.select("a", F.col("k").alias("w"), F.col("i").alias("positive_id"), F.col("s").alias("positive_score")))
    limits = best.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "positive_score"))), lambda x: x["positive_score"]).alias("p"))
    ready = anchors.join(limits, anchors["i"] == limits["a"]).select("i", "l", "v", "p")
    found = grid(ready, lambda batches: _negatives(batches, positives, k, low, high)).withColumn("rank", _better("a", "w")).where(F.col("rank") <= k)
    found = found.withColumn("w", F.col("w") + 1).join(best, ["a", "w"])
    return found.select(F.col("a").alias("anchor_id"), "positive_id", "rank", F.col("i").alias("negative_id"), "positive_score", F.col("s").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0, label=label)


ORACLE = """
WITH e AS (SELECT vec_id AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i AS a, e.i AS i, a.l = e.l AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, e.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS s FROM e a JOIN e ON a.i <> e.i WHERE a.i % 50 = 0),
p AS (SELECT a, i AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, i) <= 5),
n AS (SELECT p.a, p.p, p.ps, s.i, s.s, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.i) AS r FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.ps <= 100 * s.s AND 100 * s.s <= 95 * p.ps)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, i AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE r <= 3
"""
