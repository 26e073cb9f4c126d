"""Cases that a review found, against the SQL or a plain restatement."""

import datetime
import random
import unicodedata
from pathlib import Path

import pandas as pd
import pytest
from loomgraph import shared
from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators import retrieve as R
from loomgraph.plans import tables, text_queries
from loomgraph.streaming import progress
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def against_sql(spark, top, name, query, **tables):
    """The rows of a query and of its SQL over tables written to a folder."""
    import duckdb

    c = duckdb.connect()
    for t, rows in tables.items():
        rows.to_parquet(f"{top}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{top}/{t}.parquet'")
    want = c.execute(text_queries.ORACLE[name])
    cols = [d[0] for d in want.description]
    return sorted(map(tuple, query(spark, str(top)).select(*cols).collect())), sorted(want.fetchall())


def test_question_terms_keep_the_engine_stop_terms(spark, tmp_path):
    """Only the five words of the SQL are left out, not the retriever's own."""
    items = pd.DataFrame({"item_id": [1, 2, 3], "text": ["Which drug does reduce the risk?", "graph", "what the"]})
    got, want = against_sql(spark, tmp_path, "question_terms", text_queries.question_terms, benchmark=items)
    assert got == want == [(1, 4, "does,drug,reduce,risk"), (2, 1, "graph")]


def test_sections_are_capitals_of_one_letter(spark, tmp_path):
    docs = pd.DataFrame({"doc_id": [1, 2, 3, 4], "text": ["ßa\nb", "ŉ", "ᾳ x", "élan\n\nélan"]})
    got, want = against_sql(spark, tmp_path, "chunk_passage_overlap", text_queries.chunk_passage_overlap, documents=docs)
    by_id = {r[0]: r[3:] for r in want}
    assert [(*r[:4], "".join(sorted(r[4]))) for r in got] == [(*r[:4], "".join(sorted(r[4]))) for r in want]  # the SQL leaves the order of sections open
    assert by_id[1][0] == "ẞ" and got[0][4] == "ẞB" and got[3][3:] == ("É", "É")


def test_initial_is_one_character(spark):
    """Every letter: as many characters as before, and the same as upper where that gives one."""
    letters = [chr(c) for c in range(0x20, 0x10000) if unicodedata.category(chr(c))[0] == "L"]
    df = spark.createDataFrame([(c,) for c in letters], "c string").select("c", T.initial(F.col("c")).alias("a"), F.upper("c").alias("b"))
    rows = df.collect()
    assert all(len(a) == 1 for _, a, _ in rows)
    assert all(a == b for _, a, b in rows if len(b) == 1)
    assert {a for c, a, _ in rows if c in "ßᾳŉ"} == {"ẞ", "ᾼ", "ŉ"}


def test_progress_is_a_sum_of_batches(spark, tmp_path):
    """No frame and no stored state a document without a timeout; events before 1970 tell a status, events without a time only count, and a
    null key is a key."""
    schema = "job_id long, document string, event string, at timestamp, seq long"
    at = lambda s: datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=s)
    for rows in (
        [(1, "a", "article_finished", at(-5), 2), (1, "a", "article_started", at(-9), 1), (1, "b", "article_started", None, 3)],
        [(None, None, "article_started", at(4), 4), (1, "a", "note", at(50), 5), (1, "a", "article_failed", at(-5), 1)],
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        progress.follow(spark, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert not (tmp_path / "cp" / "state").exists()
    state = progress.states(spark, f"{tmp_path}/out")
    got = {(r["job_id"], r["document"]): (r["status"], r["started_at"], r["finished_at"], r["n_events"]) for r in state.collect()}
    assert got == {("1", "a"): ("completed", at(-9), at(-5), 4), ("1", "b"): ("queued", None, None, 1), (None, None): ("running", at(4), None, 1)}
    assert {r["job_id"]: r["n_events"] for r in progress.job_counts(state).collect()} == {"1": 5, None: 1}


def small_graph(spark, seed):
    rng = random.Random(seed)
    names = [(f"n{k}", rng.choice(["Drug", "Condition", "Paper"]), f"name {k}") for k in range(60)]
    ends = [n for n, _, _ in names] + [None, "gone"]
    rows = [(f"e{k}", rng.choice(["TREATS", "ASSOCIATED_WITH", "MENTIONS"]), rng.choice(ends), rng.choice(ends), rng.choice([0.5, None])) for k in range(150)]
    return spark.createDataFrame(names, "id string, label string, name string"), spark.createDataFrame(rows, "id string, type string, src string, dst string, confidence double")


@pytest.mark.parametrize("limit", [0, 1000])
def test_neighbourhood_holds_every_path(spark, monkeypatch, limit):
    """The same paths as over the whole graph, whether the ids are few or not, from a part of it."""
    monkeypatch.setattr(shared, "FEW", limit)
    n, e = small_graph(spark, 3)
    starts = spark.createDataFrame([(1, f"n{k}", [], k < 2) for k in range(4)], "q int, id string, types array<string>, wants_path boolean")
    hops = starts.where("wants_path")
    near, known = G.neighbourhood(starts, e, n, hops, spark.createDataFrame([("e7",), ("e8",)], "id string"))
    plain = {r["id"] for r in e.where("type <> 'MENTIONS'").collect()}
    got = [r["id"] for r in near.collect()]
    assert len(got) == len(set(got)) and set(got) < plain and {"e7", "e8"} & plain <= set(got)
    for paths in (lambda a, b: R.direct_paths(starts, a), lambda a, b: R.two_hop_paths(hops, a, b)):
        want = sorted((r["q"], r["rels"]) for r in paths(e, n).collect())
        assert want and sorted((r["q"], r["rels"]) for r in paths(near, known).collect()) == want
    asked = R.analysed(spark.createDataFrame([(1, "which path connects name 3 and name 9")], "q int, question string"))
    two = R.two_hop_paths(hops, e, n)
    assert sorted(map(tuple, R.scored(two, near, known, asked).collect())) == sorted(map(tuple, R.scored(two, e, n, asked).collect()))


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
def test_edges_away_from_the_ids_are_not_aggregated(spark):
    """Few ids are met below the aggregate that makes the edges, so what lies elsewhere is never shuffled."""
    ids = spark.createDataFrame([("drug:1",), ("condition:2",)], "id string")
    found = G.around(tables.edges(spark, SF).where("type <> 'MENTIONS'"), ids)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    over = [k for k, line in enumerate(lines) if "Join LeftSemi" in line]
    below = [k for k in over if any("Aggregate" in lines[j] and depth(lines[j]) < depth(lines[k]) for j in range(k))]
    assert len(below) >= 2 and "MENTIONS" not in "".join(lines)
    every = tables.edges(spark, SF).where("type <> 'MENTIONS' and (src in ('drug:1', 'condition:2') or dst in ('drug:1', 'condition:2'))")
    assert sorted(map(str, found.collect())) == sorted(map(str, every.collect())) != []


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")
def test_many_ids_are_sifted_before_anything_is_shuffled(spark, monkeypatch):
    """More ids than are broadcast: nearly all other edges are dropped below the aggregate that makes them, and nearly all other nodes before a shuffle."""
    monkeypatch.setattr(shared, "FEW", 20)
    ids = tables.nodes(spark, SF).where("label in ('Condition', 'Biomarker')").select("id")
    assert ids.count() > 20
    e = tables.edges(spark, SF).where("type <> 'MENTIONS'").select("id", "type", "src", "dst", "confidence")
    few = spark.createDataFrame([(f"drug:{k}",) for k in range(25)], "id string")
    found = G.around(e, few)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    below = [k for k, line in enumerate(lines) if "Join LeftSemi" in line and "_bits" in line and any("Aggregate" in lines[j] and depth(lines[j]) < depth(line) for j in range(k))]
    assert len(below) >= 2
    names = ", ".join(f"'drug:{k}'" for k in range(25))
    assert sorted(map(str, found.collect())) == sorted(map(str, e.where(f"src in ({names}) or dst in ({names})").collect())) != []
    n = tables.nodes(spark, SF)
    assert sorted(map(str, G.among(n, ids).collect())) == sorted(map(str, n.where("label in ('Condition', 'Biomarker')").collect()))


def test_sieve_drops_no_key(spark, monkeypatch):
    """Keys of another type, null keys and repeats; at most FEW rows of bits, and few other values pass."""
    monkeypatch.setattr(shared, "FEW", 500)
    keys = spark.range(1000).selectExpr("cast(id * 7 as int) as k").unionByName(spark.createDataFrame([(None,), (7,)], "k int"))
    assert shared.sieve(keys, "k").count() <= 500
    rows = spark.range(20_000).selectExpr("id", "cast(id as string) as t").unionByName(spark.createDataFrame([(None, None)], "id long, t string"))
    found = shared.sought(keys, "k")
    for c in ("id", "t"):
        assert sorted(r["id"] for r in found(rows, c).collect()) == [k * 7 for k in range(1000)]
        assert found(rows, c, "left_anti").count() == 19_001
    passed = rows.join(shared.sieve(keys, "k"), (shared._place(F.col("id"))[0] == F.col("_row")) & (F.getbit("_bits", shared._place(F.col("id"))[1]) == 1), "left_semi").count()
    assert 1000 <= passed < 2000
