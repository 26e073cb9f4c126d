"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): the pairwise part
in linear time by the sum-of-squares identity.  Features: counts of words hashed to DIMS
buckets, scaled to unit length, and STATS (symbol, capital, digit and repetition shares, word
and text lengths) and metadata columns (METADATA, as far as ``docs`` has them; signed logarithms),
standardised; missing metadata count as the mean.  Labels, language, source and keys are never inputs.

The model is fitted on the driver from at most ``TRAIN_ROWS`` labelled rows, chosen by a hash of
the key, so the matrix is bounded (TRAIN_ROWS x (DIMS + STATS + METADATA) floats); scoring covers every
document and whole texts, in Arrow batches cut by bytes.

Defined cases: a null or empty text has all features zero and gets the score of that point; rows
with a null key or label are never learned from, and those with a null key count as not held
out; several labels of a document are as many training rows, repeats of a document are one; with no labels or only one kind
the score is the smoothed share of label 1; repeated rows have equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import scan
from ..shipping import ship

TRAIN_ROWS = 3000
DIMS = 1 << 12
RANK = 8
EPOCHS = 40
BATCH = 128
RATE = 0.02
DECAY = 1e-3
CUT = 0.3
STATS = ("symbols", "capitals", "digits", "spaces", "lines", "word_bytes", "repeats", "log_words", "non_ascii", "any")
METADATA = ("n_chars",)
_CLASSES = {"symbols": b"#*$%&|<>!{}[]~^=", "capitals": bytes(range(65, 91)), "digits": b"0123456789", "spaces": b" \t\r\v\f", "lines": b"\n", "non_ascii": bytes(range(128, 256))}


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse words (row, bucket, value) and the dense statistics of each text."""
    buf, offsets = scan.texts_of(column)
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    stats = np.zeros((n, len(STATS)))
    for name, chars in _CLASSES.items():
        inside = np.zeros(256, np.int64)
        inside[list(chars)] = 1
        sums = np.concatenate([[0], np.cumsum(inside[buf])])
        stats[:, STATS.index(name)] = (sums[offsets[1:]] - sums[offsets[:-1]]) / size
    starts, ends, h, first = scan.words(scan.LOWER[buf], offsets, scan.NOT_SPACE)
    count = np.diff(first)
    row = np.repeat(np.arange(n), count)
    stats[:, STATS.index("word_bytes")] = np.bincount(row, ends - starts, n) / np.maximum(count, 1) / 10
    stats[:, STATS.index("log_words")] = np.log1p(count) / 10
    stats[:, STATS.index("any")] = count > 0
    key, times = np.unique(row * DIMS + (h >> np.uint64(52)).astype(np.int64), return_counts=True)
    row, bucket, value = key // DIMS, key % DIMS, times.astype(np.float64)
    stats[:, STATS.index("repeats")] = 1 - np.bincount(row, minlength=n) / np.maximum(count, 1)
    norm = np.sqrt(np.bincount(row, value**2, n))
    return row, bucket, value / norm[row], stats * (count > 0)[:, None]


def with_metadata(stats: np.ndarray, columns: Sequence[pa.Array]) -> np.ndarray:
    """The statistics, then the signed logarithm of each metadata column, NaN where it is missing or not finite."""
    out = [stats]
    for c in columns:
        x = np.asarray(pc.fill_null(c.cast(pa.float64()), np.nan), float)
        out.append(np.where(np.isfinite(x), np.sign(x) * np.log1p(np.abs(x)), np.nan)[:, None])
    return np.hstack(out)


class Machine:
    """w0, w, v over DIMS + STATS + metadata features; mean and scale of all but the words."""

    def __init__(self, rank: int = RANK, meta: Sequence[str] = ()) -> None:
        self.meta, n = tuple(meta), len(STATS) + len(meta)
        d = DIMS + n
        self.w0, self.w, self.v = 0.0, np.zeros(d), np.random.default_rng(7).normal(0, 0.01, (d, rank))
        self.mean, self.scale = np.zeros(n), np.ones(n)

    def standard(self, stats: np.ndarray) -> np.ndarray:
        s = (stats - self.mean) / self.scale
        return np.clip(np.where(np.isnan(s), 0, s), -8, 8)

    def raw(self, n: int, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        s = self.standard(stats)
        out = self.w0 + np.bincount(row, self.w[bucket] * value, n) + s @ self.w[DIMS:]
        for f in range(self.v.shape[1]):
            x = self.v[bucket, f] * value
            own = s * self.v[DIMS:, f]
            out += 0.5 * ((np.bincount(row, x, n) + own.sum(1)) ** 2 - np.bincount(row, x * x, n) - (own**2).sum(1))
        return out

    def fit(self, x: np.ndarray, stats: np.ndarray, y: np.ndarray) -> Machine:
        """Adam on the logistic loss; x: dense word features, float32."""
        if not len(y) or y.min() == y.max():
            self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
            self.v[:] = 0
            return self
        there = ~np.isnan(stats)
        self.mean = np.where(there, stats, 0).sum(0) / np.maximum(there.sum(0), 1)
        self.scale = np.sqrt((np.where(there, stats - self.mean, 0) ** 2).sum(0) / np.maximum(there.sum(0), 1)) + 1e-6
        x = np.hstack([x, self.standard(stats).astype(np.float32)])
        w0, w, v = np.array([np.log(y.mean() / (1 - y.mean()))]), self.w.copy(), self.v.copy()
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w0, w, v)]
        rng, t = np.random.default_rng(11), 0
        for _ in range(EPOCHS):
            for own in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
                a, t = x[own].astype(np.float64), t + 1
                xv = a @ v
                g = (1 / (1 + np.exp(-np.clip(w0 + a @ w + 0.5 * (xv**2 - (a**2) @ (v**2)).sum(1), -30, 30))) - y[own]) / len(own)
                grads = (g.sum(keepdims=True), a.T @ g + DECAY * w, a.T @ (g[:, None] * xv) - ((a**2).T @ g)[:, None] * v + DECAY * v)
                for p, (m, s), d in zip((w0, w, v), state, grads, strict=True):
                    m += 0.1 * (d - m)
                    s += 0.001 * (d * d - s)
                    p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        self.w0, self.w, self.v = float(w0[0]), w, v
        return self

    def pack(self) -> tuple:
        return self.w0, self.w, self.v, self.mean, self.scale, self.meta

    @classmethod
    def of(cls, packed: tuple) -> Machine:
        m = cls(1)
        m.w0, m.w, m.v, m.mean, m.scale, m.meta = packed
        return m


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS, meta: Sequence[str] | None = None) -> Machine:
    """A machine fitted on at most ``rows`` labelled rows; ``meta``: numeric columns of ``docs``, those of METADATA by default."""
    meta = [c for c in METADATA if c in docs.columns] if meta is None else list(meta)
    numbers = [f"m{i}" for i in range(len(meta))]
    spark = docs.sparkSession
    ship(spark)
    own = labels.select(F.col(key).alias("_k"), F.col(label).cast("double").alias("y")).where("_k is not null and y is not null")
    sample = own.orderBy(F.xxhash64(F.col("_k").cast("string"), F.lit(3)), "_k", "y").limit(rows)  # a top-k: each task sends that many rows at most
    own = docs.select(F.col(key).alias("_d"), F.col(text).alias("t"), *[F.col(c).cast("double").alias(m) for c, m in zip(meta, numbers, strict=True)]).join(F.broadcast(sample.select("_k").distinct()), F.col("_d") == F.col("_k"), "left_semi").distinct()
    place = F.xxhash64(F.col("_d").cast("string"), "t", *numbers)
    given = own.join(F.broadcast(sample), F.col("_d") == F.col("_k")).select("t", "y", place.alias("h"), *numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan.pieces_of(batches, "t"):
            row, bucket, value, stats = features(b.column("t"))
            stats = with_metadata(stats, [b.column(m) for m in numbers])
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(bucket.astype(np.int32)))
            values = pa.ListArray.from_arrays(pa.array(cuts), pa.array(value.astype(np.float32)))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("h"), lists, values, pa.array(list(stats), pa.list_(pa.float64()))], ["y", "h", "b", "v", "s"])

    # a key may have several texts: the limit bounds what the driver takes, in an order that does not favour a label
    got = given.mapInArrow(run, "y double, h long, b array<int>, v array<float>, s array<double>").orderBy("h", F.xxhash64("h", "y")).limit(rows).toArrow()
    x = np.zeros((got.num_rows, DIMS), np.float32)
    for i, (b, v) in enumerate(zip(got["b"], got["v"], strict=True)):
        x[i, np.asarray(b.values)] = np.asarray(v.values)
    stats = np.array(got["s"].to_pylist(), float).reshape(got.num_rows, len(STATS) + len(meta))
    return Machine(meta=meta).fit(x, stats, np.asarray(got["y"], float))


def scored(docs: DataFrame, model: Machine, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; they have the metadata columns that the model learned from."""
    ship(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(model.pack())
    kept = docs.drop(into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.of(packed.value)
        for b in scan.pieces_of(batches, text):
            row, bucket, value, stats = features(b.column(text))
            raw = m.raw(b.num_rows, row, bucket, value, with_metadata(stats, [b.column(c) for c in m.meta]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], [*b.schema.names, into])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(into, DoubleType())]))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *METADATA)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
