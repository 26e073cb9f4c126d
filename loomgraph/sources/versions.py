"""Tables as folders of versions: rewrites that delete, swapped in at once, and safe to repeat.

A table's folder holds versions ``v000001-<name of the change>``.  A change writes the whole new version beside them, into a
folder that no reader looks at, and then renames it: readers see the version before or the one after, never a part.  The name of a
change is its identity, so a call that is repeated after a failure finds its version there and does nothing.  Older
versions go once the new one is in place.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system that holds a path, and a maker of its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[str]:
    """The names of a table's whole versions, oldest first."""
    fs, at = _store(spark, path)
    if not fs.exists(at(path)):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(at(path)) if s.isDirectory()]
    return sorted(n for n in found if re.fullmatch(r"v\d{6}-.+", n) and fs.exists(at(f"{path}/{n}/_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as it stands."""
    found = versions(spark, path)
    if not found:
        raise ValueError(f"no version of a table: {path}")
    return spark.read.parquet(f"{path}/{found[-1]}")


def rewrite(spark: SparkSession, path: str, change: str, make: Callable[[], DataFrame], keep: int = 1) -> bool:
    """Puts ``make()`` in place of the table, unless the named change has been made; the last ``keep`` versions stay."""
    if not re.fullmatch(r"[A-Za-z0-9_.]+", change):
        raise ValueError("a change is named by letters, digits, dots and underscores")
    found = versions(spark, path)
    if any(n.split("-", 1)[1] == change for n in found):
        return False
    fs, at = _store(spark, path)
    number = int(found[-1][1:7]) + 1 if found else 1
    stage = f"{path}/_stage_{uuid.uuid4().hex}"
    make().write.parquet(stage)
    if not fs.rename(at(stage), at(f"{path}/v{number:06d}-{change}")):
        raise OSError(f"another change took the place of version {number} of {path}")
    for n in versions(spark, path)[: -max(1, keep)]:
        fs.delete(at(f"{path}/{n}"), True)
    for s in fs.listStatus(at(path)):  # what a change that failed has left
        if s.getPath().getName().startswith("_stage_"):
            fs.delete(s.getPath(), True)
    return True


def delete_nodes(spark: SparkSession, nodes: str, edges: str, doomed: Column, change: str) -> None:
    """Deletes the nodes that satisfy a test, and the edges that then dangle.  Edges go first: a failure in between leaves a graph without
    dangling edges, and the repeated call finishes it."""
    n, e = current(spark, nodes), current(spark, edges)
    rewrite(spark, edges, change, lambda: G.without(n, e, doomed)[1], keep=2)
    rewrite(spark, nodes, change, lambda: n.where(~F.coalesce(doomed, F.lit(False))), keep=2)


def clear(spark: SparkSession, nodes: str, edges: str, typed: str, active_jobs: int, change: str) -> None:
    """Deletes the whole graph; only for the typed word DELETE and with no job active."""
    if typed != "DELETE" or active_jobs:
        raise ValueError("clearing needs the typed word DELETE and no active job")
    delete_nodes(spark, nodes, edges, F.lit(True), change)


def seed(spark: SparkSession, nodes: str, edges: str, new_nodes: DataFrame, new_edges: DataFrame, change: str) -> None:
    """Adds nodes and edges by id; one that is there takes the new values that are set."""
    for path, new in ((nodes, new_nodes), (edges, new_edges)):
        old = current(spark, path)
        named = [c for c in old.columns if c != "id"]
        both = lambda df: df.select("id", *[F.col(c) if c in df.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in named], F.lit(0).cast("long").alias("_seq"))  # noqa: B023, E731
        rewrite(spark, path, change, lambda: G.upsert(both(old), both(new), ["id"], "_seq").select(*old.columns), keep=2)  # noqa: B023


def prune_folders(spark: SparkSession, root: str, decided: DataFrame, dry_run: bool = True) -> list[str]:
    """Deletes the folders of the runs that are ``selected`` in (run, action), and returns their names; a dry run only names them.

    Names that are no plain folder below ``root`` are refused; one that is gone already is none to delete.
    """
    fs, at = _store(spark, root)
    names = sorted(r["run"] for r in decided.where("action = 'selected'").select("run").distinct().collect())  # a row a run folder
    for n in names:
        if not n or n in (".", "..") or "/" in n or "\\" in n:
            raise ValueError(f"not the name of a run's folder: {n!r}")
    there = [n for n in names if fs.exists(at(f"{root.rstrip('/')}/{n}"))]
    if not dry_run:
        for n in there:
            fs.delete(at(f"{root.rstrip('/')}/{n}"), True)
    return there
