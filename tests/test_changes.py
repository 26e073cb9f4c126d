"""Deletes that delete, numbered lines across splits, strict folders, and progress of documents over restarts."""

import datetime
import json
import random

import pytest
from loomgraph.sources import readers, versions
from loomgraph.streaming import jobs, progress
from pyspark.sql import functions as F

N = "id string, label string, name string"
E = "id string, type string, src string, dst string, confidence double"


@pytest.fixture
def graph(spark, tmp_path):
    n = spark.createDataFrame([("a", "Drug", "x"), ("b", "Condition", "y"), ("c", "Drug", None)], N)
    e = spark.createDataFrame([("1", "TREATS", "a", "b", 0.5), ("2", "TREATS", "c", "b", None), ("3", "X", "c", "c", 1.0)], E)
    paths = f"{tmp_path}/n", f"{tmp_path}/e"
    for path, df in zip(paths, (n, e), strict=True):
        assert versions.rewrite(spark, path, "load", lambda df=df: df)
    return paths


def ids(spark, path):
    return sorted(r["id"] for r in versions.current(spark, path).collect())


def test_tagged_delete_and_seed(spark, graph):
    n, e = graph
    for _ in range(2):
        versions.delete_nodes(spark, n, e, F.col("name") == "x", "no_x")  # a null name is not doomed
        assert ids(spark, n) == ["b", "c"] and ids(spark, e) == ["2", "3"]
    new_n, new_e = spark.createDataFrame([("c", "named"), ("d", "fresh")], "id string, name string"), spark.createDataFrame([("9", "TREATS", "d", "b", 0.25)], E)
    for _ in range(2):
        versions.seed(spark, n, e, new_n, new_e, "sample")
        assert {r["id"]: (r["label"], r["name"]) for r in versions.current(spark, n).collect()} == {"b": ("Condition", "y"), "c": ("Drug", "named"), "d": (None, "fresh")}
        assert ids(spark, e) == ["2", "3", "9"]
    assert len(versions.versions(spark, n)) == 2  # older ones are gone


def test_clear_finishes_after_a_failure(spark, graph, monkeypatch):
    n, e = graph
    for typed, active in (("delete", 0), ("DELETE", 1)):
        with pytest.raises(ValueError):
            versions.clear(spark, n, e, typed, active, "clear")
    plain = versions.rewrite

    def failing(spark, path, *args, **more):
        if path == n:
            raise OSError("lost")
        return plain(spark, path, *args, **more)

    monkeypatch.setattr(versions, "rewrite", failing)
    with pytest.raises(OSError):
        versions.clear(spark, n, e, "DELETE", 0, "clear")
    assert ids(spark, e) == [] and ids(spark, n) == ["a", "b", "c"]  # whole versions, no dangling edge
    monkeypatch.undo()
    versions.clear(spark, n, e, "DELETE", 0, "clear")
    assert ids(spark, n) == [] and versions.current(spark, n).columns == ["id", "label", "name"]


def test_a_failed_write_changes_nothing(spark, graph):
    n, _ = graph
    with pytest.raises(Exception, match="no such thing"):
        versions.rewrite(spark, n, "bad", lambda: versions.current(spark, n).withColumn("name", F.raise_error(F.lit("no such thing")).cast("string")))
    assert ids(spark, n) == ["a", "b", "c"]
    assert versions.rewrite(spark, n, "good", lambda: versions.current(spark, n)) and not versions.rewrite(spark, n, "good", lambda: None)
    with pytest.raises(ValueError):
        versions.rewrite(spark, n, "a/b", lambda: None)


def test_pruned_folders_are_gone(spark, tmp_path):
    for r in ("r1", "r2", "r3"):
        (tmp_path / r / "deep").mkdir(parents=True)
        (tmp_path / r / "deep" / "f.txt").write_text("x")
    decided = spark.createDataFrame([("r1", "selected"), ("r2", "protected"), ("r3", "selected"), ("gone", "selected")], "run string, action string")
    assert versions.prune_folders(spark, str(tmp_path), decided) == ["r1", "r3"] and (tmp_path / "r1").exists()
    assert versions.prune_folders(spark, str(tmp_path), decided, dry_run=False) == ["r1", "r3"]
    assert versions.prune_folders(spark, str(tmp_path), decided, dry_run=False) == []
    assert sorted(x.name for x in tmp_path.iterdir()) == ["r2"]
    for bad in ("..", "a/b", ""):
        with pytest.raises(ValueError):
            versions.prune_folders(spark, str(tmp_path), spark.createDataFrame([(bad, "selected")], "run string, action string"))


def test_lines_are_numbered_across_splits(spark, tmp_path):
    rng = random.Random(2)
    want = {}
    for name in ("b.txt", "a.txt"):
        lines = [rng.choice(["", "# note", "  ", f"PMC{k}", f" {k} "]) + "x" * 0 for k in range(1, 4000)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want[name] = lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = readers.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 3
        rows = got.collect()
        assert {(r["file"].rpartition("/")[2], r["line"]): r["value"] for r in rows} == {(f, i): x for f, xs in want.items() for i, x in enumerate(xs, 1)}
        assert [r["pos"] for r in sorted(rows, key=lambda r: (r["file"], r["line"]))] == list(range(1, len(rows) + 1))
        found = readers.distinct_ids(readers.id_lines(spark, str(tmp_path))).collect()
        first = list(dict.fromkeys("PMC" + x.strip().removeprefix("PMC") for f in ("a.txt", "b.txt") for x in want[f] if x.strip() and not x.startswith("#")))
        assert [r["id"] for r in sorted(found, key=lambda r: r["pos"])] == first
        (tmp_path / "c.txt").write_text("PMC1\n" * 2500 + "# fine\nPMC x\n")
        with pytest.raises(Exception, match=r"c\.txt:2502: not a PMC id: PMC x"):
            readers.distinct_ids(readers.id_lines(spark, str(tmp_path / "c.txt"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_free_ids_of_long_lines(spark):
    text = " ".join(f"PMC{k}" for k in range(150000)) + "\nPMC7 PMC999999"
    got = readers.free_ids(spark.createDataFrame([(text,)], "t string"), "t")
    assert got.count() == 150002 and got.select("pos").distinct().count() == 150002
    assert got.orderBy(F.desc("pos")).first()["value"] == "PMC999999"


def test_processed_folders_are_strict(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no processed files"):
        readers.processed(spark, str(tmp_path / "empty"))
    (tmp_path / "p").mkdir()
    for k in (2, 1):
        (tmp_path / "p" / f"{k}.json").write_text(json.dumps({"id": k, "chunks": [{"t": "x"}]}, indent=1))
    assert [r["id"] for r in readers.processed(spark, str(tmp_path / "p")).collect()] == [1, 2]
    for bad in ("[1]", "3", "", "not json {"):
        (tmp_path / "p" / "3.json").write_text(bad)
        with pytest.raises(ValueError, match=r"not a JSON object: .*3\.json"):
            readers.processed(spark, str(tmp_path / "p"))


EVENTS = "job_id int, document string, event string, at timestamp, seq long"


def at(s):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)


def follow(spark, top, rows, timeout_ms=0):
    spark.createDataFrame([(j, d, e, at(s), k) for j, d, e, s, k in rows], EVENTS).coalesce(1).write.mode("append").parquet(f"{top}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{top}/in")
    progress.follow(spark, stream, f"{top}/out", f"{top}/cp", timeout_ms)
    return {(r["job_id"], r["document"]): r for r in progress.states(spark, f"{top}/out").collect()}


def test_progress_over_restarts_and_out_of_order(spark, tmp_path):
    """Every call is a new query from the checkpoint; the states are those of all events in their own order."""
    got = follow(spark, tmp_path, [(1, "a", "article_started", 10, 1), (1, "b", "article_finished", 30, 2), (2, "c", "note", 1, 1)])
    assert {k: r["status"] for k, r in got.items()} == {("1", "a"): "running", ("1", "b"): "completed", ("2", "c"): "queued"}
    got = follow(spark, tmp_path, [(1, "a", "article_failed", 20, 5), (1, "b", "article_started", 5, 1), (1, "a", "article_started", 12, 4)])
    a, b = got["1", "a"], got["1", "b"]
    assert (a["status"], a["started_at"], a["finished_at"], a["n_events"]) == ("failed", at(10), at(20), 3)
    assert (b["status"], b["started_at"], b["finished_at"], b["n_events"]) == ("completed", at(5), at(30), 2)  # the start came late
    got = follow(spark, tmp_path, [(1, "a", "article_started", 20, 6)])  # tried again: same time, later number
    assert got["1", "a"]["status"] == "running"
    counts = {r["job_id"]: (r["n_documents"], r["n_events"], r["running"], r["completed"]) for r in progress.job_counts(progress.states(spark, f"{tmp_path}/out")).collect()}
    assert counts == {"1": (2, 6, 1, 1), "2": (1, 1, 0, 0)}
    before = sorted(map(tuple, progress.states(spark, f"{tmp_path}/out").collect()))
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    progress.follow(spark, stream, f"{tmp_path}/out", f"{tmp_path}/cp")  # nothing new
    assert sorted(map(tuple, progress.states(spark, f"{tmp_path}/out").collect())) == before


def test_documents_that_are_left_behind_fail(spark, tmp_path):
    follow(spark, tmp_path, [(1, "a", "article_started", 0, 1), (1, "b", "article_started", 0, 2)], 60_000)
    follow(spark, tmp_path, [(1, "b", "article_finished", 30, 3), (1, "z", "article_started", 500, 4)], 60_000)
    got = follow(spark, tmp_path, [(1, "z", "article_finished", 501, 5)], 60_000)
    assert {k[1]: (r["status"], r["error"]) for k, r in got.items()} == {"a": ("failed", jobs.INTERRUPTED), "b": ("completed", ""), "z": ("completed", "")}
