"""The ingestion job queue: progress, FIFO claims, state changes, recovery, and a streaming worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Document statuses that count as done, and what a restart tells.
DONE = ["completed", "failed", "skipped"]
INTERRUPTED = "Ingestion job was interrupted before completion, likely because the API restarted."
#: Which states a job may move to.
MOVES = {"queued": ["running", "cancelled"], "running": ["completed", "failed"], "completed": [], "failed": [], "cancelled": []}


def progress(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs with the number of their documents, of those done, and the share done."""
    d = documents.groupBy(F.col("job_id").alias("_j")).agg(F.count("*").alias("n_documents"), F.count_if(F.col("status").isin(DONE)).alias("n_done"))
    out = jobs.join(d, F.col("job_id") == F.col("_j"), "left").drop("_j")
    n = F.coalesce("n_documents", F.lit(0))
    return out.withColumns({"n_documents": n, "n_done": F.coalesce("n_done", F.lit(0)), "progress": F.when(n > 0, F.round(F.col("n_done") / n, 6)).otherwise(0.0)})


def next_job(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The jobs that have been queued longest."""
    return jobs.where("status = 'queued'").orderBy("submitted_at", "job_id").limit(n)


def moved(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs after the wanted (job_id, to) changes; a change that the state machine does not allow is left out."""
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]).cast("array<string>"))])
    w = wanted.groupBy(F.col("job_id").alias("_j")).agg(F.min("to").alias("_to"))
    ok = F.coalesce(F.array_contains(F.element_at(allowed, F.col("status")), F.col("_to")), F.lit(False))
    return jobs.join(w, F.col("job_id") == F.col("_j"), "left").withColumn("status", F.when(ok, F.col("_to")).otherwise(F.col("status"))).drop("_j", "_to")


def recovered(jobs: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a restart: running jobs and their open documents have failed; an error that is there stays."""
    told: Column = F.when(F.coalesce("error", F.lit("")) == "", INTERRUPTED).otherwise(F.col("error"))
    was = jobs.where("status = 'running'").select(F.col("job_id").alias("_j")).withColumn("_hit", F.lit(True))
    j = jobs.withColumns({"error": F.when(F.col("status") == "running", told).otherwise(F.col("error")), "status": F.when(F.col("status") == "running", "failed").otherwise(F.col("status"))})
    d = documents.join(was, F.col("job_id") == F.col("_j"), "left")
    hit = F.coalesce("_hit", F.lit(False)) & ~F.col("status").isin(DONE)
    d = d.withColumns({"error": F.when(hit, told).otherwise(F.col("error")), "status": F.when(hit, "failed").otherwise(F.col("status"))}).drop("_j", "_hit")
    return j, d


def work(spark: SparkSession, folder: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*.parquet") -> None:
    """Handles everything that has arrived in a folder since the last call, then returns.

    ``handle`` gets each micro-batch and its number; ids are deterministic and sinks overwrite by batch
    number, so a batch that is replayed after a failure has no second effect.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keep_manifest(spark: SparkSession, folder: str, schema: str, path: str, columns: list[str], checkpoint: str, glob: str = "*.parquet") -> None:
    """The manifest after each batch of finished items: its rows go to a folder of the batch's own, with a header and a fixed order of
    columns, so what is done by then can be read at any time, and a batch that is replayed writes the same folder again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*columns).write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}")

    work(spark, folder, schema, write, checkpoint, glob)


def counts(spark: SparkSession, folder: str, schema: str, glob: str, by: str, name: str) -> DataFrame:
    """Running counts per key over a stream of progress events, as they stand when the stream is drained."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    out = stream.groupBy(by).agg(F.count("*").alias("n"))
    out.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
