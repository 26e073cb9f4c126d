"""Runs and their files: inventory, hashes, indexes and what may be pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of every file below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", "length", F.sha2("content", 256).alias("sha256"))


def folder_stats(rows: DataFrame, depth: Column) -> DataFrame:
    """(folder, n_files, n_bytes)."""
    return rows.groupBy(depth.alias("folder")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def verified(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state): ok, changed or missing, by the recorded hash."""
    f = found.select(F.col("path").alias("_p"), F.col("sha256").alias("_h"))
    state = F.when(F.col("_p").isNull(), "missing").when(F.col("_h") == F.col("sha256"), "ok").otherwise("changed")
    return manifest.join(f, F.col("path") == F.col("_p"), "left").select("path", state.alias("state"))


def relocated(path: Column, run: Column, root: str) -> Column:
    """A recorded path of an old workspace under ``root``: what follows the run's name stays."""
    at = F.instr(path, F.concat(F.lit("/"), run, F.lit("/")))
    return F.when(at > 0, F.concat(F.lit(root.rstrip("/")), F.substr(path, at))).otherwise(path)


def inventory(runs: DataFrame, present: DataFrame, required: list[str]) -> DataFrame:
    """Runs with n_required and complete, newest first by rank."""
    have = present.where(F.col("file").isin(required)).groupBy(F.col("run").alias("_r")).agg(F.count_distinct("file").alias("n_required"))
    out = runs.join(have, F.col("run") == F.col("_r"), "left").drop("_r").withColumn("n_required", F.coalesce("n_required", F.lit(0)))
    return out.withColumns({"complete": F.col("n_required") == len(required), "rank": F.row_number().over(W.orderBy(F.desc("created"), "run"))})


def prune(runs: DataFrame, pattern: str | None = None, incomplete: bool = False, smoke: bool = False, older_than: Column | None = None, keep_latest: int = 0, profile: str | None = None) -> DataFrame:
    """(run, action): selected or protected among the runs that the filters match; pinned and active runs are never selected.

    The newest ``keep_latest`` of the candidates are protected.  A call without any restriction raises.
    """
    if pattern is None and not incomplete and not smoke and older_than is None and keep_latest <= 0 and profile is None:
        raise ValueError("pruning without any restriction is refused")
    test = F.lit(True)
    if pattern is not None:
        test = test & F.col("run").rlike("^" + "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_-" else "\\" + c) for c in pattern) + "$")
    if incomplete:
        test = test & ~F.col("complete")
    if smoke:
        test = test & F.contains("run", F.lit("smoke"))
    if older_than is not None:
        test = test & (F.col("created") < older_than)
    if profile is not None:
        test = test & (F.col("profile") == profile)
    safe = F.col("pinned") | F.col("active")
    cand = runs.where(test & ~safe)
    latest = cand.orderBy(F.desc("created"), "run").limit(max(keep_latest, 0)).select(F.col("run").alias("_kept"))
    cand = cand.join(latest, F.col("run") == F.col("_kept"), "left")
    return cand.select("run", F.when(F.col("_kept").isNotNull(), "protected").otherwise("selected").alias("action")).unionByName(runs.where(test & safe).select("run", F.lit("protected").alias("action")))


def report(title: str, row: dict) -> str:
    """A Markdown table of one collected row of metrics."""
    return "\n".join([f"# {title}", "", "| Metric | Value |", "| --- | ---: |", *[f"| {k.replace('_', ' ')} | {v} |" for k, v in row.items()], ""])
