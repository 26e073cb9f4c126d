"""Progress of documents from a stream of events, with a state for each document.

An event is (job_id, document, event, at, seq).  A document's state follows its events in the order (at, seq), in whatever order
they come: the latest that tells a status decides it, the first start and the last end are kept, every event counts; an event
without a time only counts.  So a state is a sum of what its events tell: each batch's sums go to a folder of the batch's own, a batch
that is replayed writes the same again, and ``states`` adds the batches up.  With a ``timeout``, a running document that the
stream's time has left behind by so much has failed.  That is no sum: the stream then keeps a state for each document (a
Pandas frame for each that has changed, some milliseconds), a batch's changed states are written, and the last of each is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .jobs import INTERRUPTED

#: The status that an event tells.
STATUS = {"article_started": "running", "article_finished": "completed", "article_failed": "failed", "article_skipped": "skipped"}
STATE = "status string, started long, finished long, n_events long, at long, seq long, version long"
ROW = "job_id string, document string, status string, started_at timestamp, finished_at timestamp, n_events long, error string, version long"
#: What a batch without a timeout tells of a document; its status is that of (at, seq).
TOLD = "job_id string, document string, status string, at timestamp, seq long, started_at timestamp, finished_at timestamp, n_events long"


def _row(key: tuple, s: tuple, error: str = "") -> pd.DataFrame:
    stamp = lambda v: pd.NaT if v < 0 else pd.Timestamp(v, unit="us")
    return pd.DataFrame({"job_id": [key[0]], "document": [key[1]], "status": [s[0]], "started_at": pd.Series([stamp(s[1])], dtype="datetime64[us]"), "finished_at": pd.Series([stamp(s[2])], dtype="datetime64[us]"), "n_events": [s[3]], "error": [error], "version": [s[6]]})


def _follow(timeout_ms: int):  # noqa: ANN202
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, started, finished, n, at, seq, version = state.get if state.exists else ("queued", -1, -1, 0, -1, -1, 0)
        error = ""
        if state.hasTimedOut:
            if status != "running":
                state.update((status, started, finished, n, at, seq, version))
                return
            status, finished, error = "failed", state.getCurrentWatermarkMs() * 1000, INTERRUPTED
        for b in batches:
            for event, t, k in zip(b["event"], b["us"], b["seq"], strict=True):
                n += 1
                told = STATUS.get(event)
                if told == "running":
                    started = t if started < 0 else min(started, t)
                if told in ("completed", "failed", "skipped"):
                    finished = max(finished, t)
                if told and (t, k) > (at, seq):
                    status, at, seq = told, t, k
        after = (status, int(started), int(finished), n, int(at), int(seq), version + 1)
        state.update(after)
        if timeout_ms and status == "running":
            state.setTimeoutTimestamp(max(after[4] // 1000 + timeout_ms, state.getCurrentWatermarkMs() + 1))
        yield _row(key, after, error)

    return step


def _latest(status: str = "status") -> Column:
    """Of the events that tell a status, the last."""
    return F.max(F.when(F.col("at").isNotNull() & F.col(status).isNotNull(), F.struct("at", "seq", F.col(status).alias("status"))))


def _told(events: DataFrame) -> DataFrame:
    """What events tell of each document."""
    status = F.coalesce(*[F.when(F.col("event") == e, F.lit(s)) for e, s in STATUS.items()])
    e = events.withColumn("status", status)
    out = e.groupBy("job_id", "document").agg(_latest().alias("x"), F.min(F.when(F.col("status") == "running", F.col("at"))).alias("started_at"), F.max(F.when(F.col("status") != "running", F.col("at"))).alias("finished_at"), F.count("*").alias("n_events"))
    return out.select("job_id", "document", "x.status", "x.at", "x.seq", "started_at", "finished_at", "n_events")


def follow(spark: SparkSession, events: DataFrame, path: str, checkpoint: str, timeout_ms: int = 0) -> None:
    """Takes all that has arrived of a streaming table of events since the last call, and writes the states that changed."""
    rows = events.select(F.col("job_id").cast("string").alias("job_id"), F.col("document").cast("string").alias("document"), "event", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"))
    out = rows
    if timeout_ms:
        told = rows.withColumn("us", F.unix_micros("at")).withWatermark("at", "0 seconds")
        out = told.groupBy("job_id", "document").applyInPandasWithState(_follow(timeout_ms), ROW, STATE, "update", GroupStateTimeout.EventTimeTimeout)

    def write(batch: DataFrame, number: int) -> None:
        (batch if timeout_ms else _told(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    mode = "update" if timeout_ms else "append"
    out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def states(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each document."""
    if "at" in spark.read.parquet(path).columns:
        sums = spark.read.schema(f"{TOLD}, batch long").parquet(path).groupBy("job_id", "document")
        out = sums.agg(_latest().alias("x"), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"), F.sum("n_events").alias("n_events"), F.count("*").alias("version"))
        return out.select("job_id", "document", F.coalesce("x.status", F.lit("queued")).alias("status"), "started_at", "finished_at", "n_events", F.lit("").alias("error"), "version")
    rows = spark.read.schema(f"{ROW}, batch long").parquet(path)
    rest = [c for c in rows.columns if c not in ("job_id", "document")]
    return rows.groupBy("job_id", "document").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("job_id", "document", *[f"s.{c}" for c in rest if c != "batch"])


def job_counts(state: DataFrame, *more: Column) -> DataFrame:
    """(job_id, n_documents, n_events, running, completed, failed, skipped) of the documents' states, and further sums."""
    tally = [F.count_if(F.col("status") == s).alias(s) for s in ("running", "completed", "failed", "skipped")]
    return state.groupBy("job_id").agg(F.count("*").alias("n_documents"), F.sum("n_events").alias("n_events"), *tally, *more)
