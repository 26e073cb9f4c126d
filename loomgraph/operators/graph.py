"""The property graph as two tables: nodes (id, label, name, ...) and edges (id, type, src, dst, confidence, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import kept, sought


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert, or overwrite property by property: of each column the value that was set last counts.

    ``old`` and ``new`` have the same columns; rows of ``new`` come later, among them by ``order``.
    A null sets nothing.  One shuffle on the keys; the maxima combine map-side.
    """
    seq = F.col(order).cast("long")
    both = old.withColumn("_at", F.struct(F.lit(0).alias("a"), seq.alias("b"))).unionByName(new.withColumn("_at", F.struct(F.lit(1).alias("a"), seq.alias("b"))))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in rest])


def upsert_properties(old: DataFrame, new: DataFrame) -> DataFrame:
    """As ``upsert`` for (id, props map<string,string>): the last value of each property; a null value removes it."""
    both = old.select("id", "props", F.lit(0).cast("long").alias("seq")).unionByName(new.select("id", "props", (F.col("seq") + 1).cast("long").alias("seq")))
    each = both.select("id", "seq", F.explode_outer("props").alias("k", "v"))
    last = each.groupBy("id", "k").agg(F.max_by(F.struct("v"), "seq").alias("x"))
    kept = F.collect_list(F.when(F.col("k").isNotNull() & F.col("x.v").isNotNull(), F.struct("k", F.col("x.v").alias("v"))))
    return last.groupBy("id").agg(F.map_from_entries(F.array_sort(kept)).alias("props"))


def attach(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges whose two ends exist, and (attempted, written): an edge without both ends is counted but not written."""
    ids = nodes.select(F.col("id").alias("_n"))
    good = edges.join(ids, F.col("src") == F.col("_n"), "left_semi").join(ids, F.col("dst") == F.col("_n"), "left_semi")
    tally = lambda rows, a, w: rows.where("type <> 'MENTIONS'").select(F.lit(a).alias("attempted"), F.lit(w).alias("written"))
    return good, tally(edges, 1, 0).unionByName(tally(good, 0, 1)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("attempted", "written")])


def mention_edges(found: DataFrame) -> DataFrame:
    """One MENTIONS edge for each (paper, entity, pmcid)."""
    d = found.select("paper", "entity", "pmcid").distinct()
    return d.select(T.key_of("rel:", F.col("paper"), F.lit("MENTIONS"), F.col("entity"), F.col("pmcid")).alias("id"), F.lit("MENTIONS").alias("type"), F.col("paper").alias("src"), F.col("entity").alias("dst"))


def loaded(nodes: DataFrame, run: str, source: str, at: str) -> DataFrame:
    """Nodes with the provenance of a load; empty optional keys are left out (null)."""
    return nodes.withColumns({**{c: F.nullif(c, F.lit("")) for c in ("pmid", "doi") if c in nodes.columns}, "graph_run_id": F.lit(run), "graph_source": F.lit(source), "graph_loaded_at": F.lit(at)})


#: The properties that a loaded edge should carry.
EDGE_FIELDS = ["id", "evidence", "confidence", "source_pmcid", "chunk_id"]


def load_report(nodes: DataFrame, edges: DataFrame, run: str, source: str, at: str, file: str = "file") -> DataFrame:
    """One row: run, source, time; the files that nodes and edges come from, entities (nodes that are no papers) and relationships
    (no mentions) by file, as each file upserts its own; and how many edges have all of ``EDGE_FIELDS``, a missing one counted by field."""
    files = nodes.select(file).unionByName(edges.select(file)).agg(F.count_distinct(file).alias("files"))
    found = nodes.where("label <> 'Paper'").select(file, "id").distinct().agg(F.count("*").alias("entities"))
    plain = edges.where("type <> 'MENTIONS'")
    has = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) != "" if c in edges.columns else F.lit(False) for c in EDGE_FIELDS}
    whole = F.lit(True)
    for test in has.values():
        whole = whole & test
    told = plain.agg(F.count_distinct(file, "id").alias("relationships"), F.count_if(whole).alias("complete"), *[F.count_if(~test).alias(f"missing_{c}") for c, test in has.items()])
    out = files.withColumn("_k", F.lit(1)).join(found.withColumn("_k", F.lit(1)), "_k").join(told.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each
    return out.select(F.lit(run).alias("graph_run_id"), F.lit(source).alias("graph_source"), F.lit(at).alias("loaded_at"), *out.columns)


def unique_violations(nodes: DataFrame, column: str) -> DataFrame:
    """Values that a unique key column holds more than once; nulls do not count."""
    return nodes.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def symmetric(edges: DataFrame) -> DataFrame:
    """(u, v, and the edge): each edge from both ends, a loop once."""
    there = edges.withColumns({"u": F.col("src"), "v": F.col("dst")})
    return there.unionByName(edges.where("src <> dst").withColumns({"u": F.col("dst"), "v": F.col("src")}))


def triples(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the labels and names of their ends."""
    n = lambda p: nodes.select(F.col("id").alias(f"_{p}"), F.col("label").alias(f"{p}_label"), F.col("name").alias(f"{p}_name"))
    return edges.join(n("src"), F.col("src") == F.col("_src")).join(n("dst"), F.col("dst") == F.col("_dst")).drop("_src", "_dst")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): nodes by label and edges by type."""
    return nodes.groupBy(F.col("label")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n").unionByName(edges.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "label", "n"))


def row_graph(rows: DataFrame) -> DataFrame:
    """Nodes at either end of (pos, src.., dst..) rows, each id once, the last row's values."""
    ends = rows.select(F.col("pos"), F.explode(F.array(*[F.struct(F.col(f"{p}").alias("id"), F.col(f"{p}_label").alias("label"), F.col(f"{p}_name").alias("name"), F.lit(k).alias("k")) for k, p in enumerate(("src", "dst"))])).alias("e"))
    return ends.groupBy("e.id").agg(F.max_by(F.struct("e.label", "e.name"), F.struct("pos", "e.k")).alias("x")).select("id", "x.label", "x.name")


def two_hop(starts: DataFrame, edges: DataFrame, nodes: DataFrame, types: list[str] | None = None, run: str = "") -> DataFrame:
    """(start, first, mid, second, finish): undirected paths of two different edges from given starts.

    Neither edge is a mention, neither middle nor finish is a paper, the finish is not the start; with
    ``types`` one of the two edges must have one of them; with ``run`` both must be of that run.  The
    starts are joined first, so the self-join only expands their neighbourhoods.
    """
    keep = edges.where("type <> 'MENTIONS'")
    if run:
        keep = keep.where(F.col("graph_run_id") == run)
    both = symmetric(keep.select("id", "type", "src", "dst", "confidence")).select("u", "v", F.col("id"), F.col("type"), F.col("confidence"))
    plain = nodes.where("label <> 'Paper'").select(F.col("id").alias("_n"))
    first = starts.select(F.col("id").alias("start")).join(both, F.col("start") == F.col("u")).join(plain, F.col("v") == F.col("_n"), "left_semi")
    first = first.select("start", F.col("v").alias("mid"), F.col("id").alias("first"), F.col("type").alias("first_type"), F.col("confidence").alias("c1"))
    second = both.join(plain, F.col("v") == F.col("_n"), "left_semi").select("u", F.col("v").alias("finish"), F.col("id").alias("second"), F.col("type").alias("second_type"), F.col("confidence").alias("c2"))
    out = first.join(second, F.col("mid") == F.col("u")).where("first <> second and start <> finish").drop("u")
    return out.where(F.col("first_type").isin(types) | F.col("second_type").isin(types)) if types else out


def around(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges, each once, that have an end among ``ids`` (id).  Only these (of many ids: few others) are shuffled, or aggregated by what makes them."""
    near = sought(ids, "id")
    return near(edges, "src").unionByName(near(near(edges, "dst"), "src", "left_anti"))


def among(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes whose id is among ``ids`` (id)."""
    return sought(ids, "id")(nodes, "id")


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def neighbourhood(starts: DataFrame, edges: DataFrame, nodes: DataFrame, hops: DataFrame | None = None, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The part of the graph, written once, that paths from ``starts`` (id) can hold, mentions apart: the edges at the starts, those at either end of the
    edges at ``hops`` (id, the starts of two-step paths), the edges named by ``more`` (id), and the nodes at their ends."""
    plain, ids = edges.where("type <> 'MENTIONS'"), starts.select("id")
    if hops is not None:
        ids = ids.unionByName(ends(around(plain, hops)))
    near = around(plain, ids)
    if more is not None:
        near = near.unionByName(among(plain, more)).distinct()
    near = kept(near)
    return near, kept(among(nodes, ends(near).unionByName(starts.select("id"))))


def incident(starts: DataFrame, edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges at either end of the starts: two equi-joins and a distinct union, never a nested loop."""
    keep = edges.where("type <> 'MENTIONS'")
    keep = keep.where(F.col("type").isin(types)) if types else keep
    s = starts.select(F.col("id").alias("start")).distinct()
    return keep.join(s, F.col("src") == F.col("start")).unionByName(keep.join(s, F.col("dst") == F.col("start"))).distinct()


def browse(nodes: DataFrame, edges: DataFrame, q: str | None = None, label: str | None = None, type_: str | None = None, pmcid: str | None = None, limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """A page of the graph: matching nodes in name order, their edges (at most min(3 * limit, 200)), and the neighbours.

    Predicates exist only for the parameters given; every cap has a total order.
    """
    shown = F.coalesce("name", "title", "pmcid", "id", F.lit("")) if "title" in nodes.columns else F.coalesce("name", "id", F.lit(""))
    found = nodes
    if label:
        found = found.where(F.lower("label") == label.lower())
    if q:
        fields = [c for c in ("name", "title", "pmcid", "pmid", "id") if c in nodes.columns]
        test = F.lit(False)
        for c in fields:
            test = test | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q.strip().lower()))
        found = found.where(test)
    if pmcid:
        paper = nodes.where((F.col("label") == "Paper") & (F.col("pmcid") == pmcid)).select(F.col("id").alias("_p"))
        hit = edges.where("type = 'MENTIONS'").join(F.broadcast(paper), F.col("src") == F.col("_p"), "left_semi").select(F.col("dst").alias("_i"))
        own = nodes.where(F.col("pmcid") == pmcid).select(F.col("id").alias("_i"))
        found = found.join(hit.unionByName(own).distinct(), F.col("id") == F.col("_i"), "left_semi")
    page = found.withColumn("_s", shown).orderBy("_s", "id").limit(limit).drop("_s")
    keep = edges.where(F.col("type") == type_.upper()) if type_ else edges
    ids = F.broadcast(page.select(F.col("id").alias("_c")))  # at most ``limit`` rows
    near = keep.join(ids, F.col("src") == F.col("_c"), "left_semi").unionByName(keep.join(ids, F.col("dst") == F.col("_c"), "left_semi")).distinct()
    cap = min(3 * limit, 200)
    shown_edges = near.orderBy("id").limit(cap)
    ends = shown_edges.select(F.explode(F.array("src", "dst")).alias("_e")).distinct()
    extra = nodes.join(F.broadcast(ends), F.col("id") == F.col("_e"), "left_semi")
    return page.unionByName(extra).distinct().orderBy("id").limit(limit + cap), shown_edges


def completeness(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, total, complete, missing): how many rows have each field."""
    agg = rows.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(v.cast("string"), F.lit("")) != "").alias(f"_{k}") for k, v in fields.items()])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"_{k}").alias("complete")) for k in fields]))
    return agg.select("total", each.alias("x")).select("x.field", "total", "x.complete", (F.col("total") - F.col("x.complete")).alias("missing"))


def without(nodes: DataFrame, edges: DataFrame, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes that satisfy a test, and without the edges that then dangle."""
    kept = nodes.where(~F.coalesce(doomed, F.lit(False)))
    ids = kept.select(F.col("id").alias("_n"))
    return kept, edges.join(ids, F.col("src") == F.col("_n"), "left_semi").join(ids, F.col("dst") == F.col("_n"), "left_semi")


def source_runs(rows: DataFrame, column: str) -> DataFrame:
    """The distinct run ids, sorted, in one array."""
    return rows.agg(F.array_sort(F.collect_set(F.nullif(column, F.lit("")))).alias("runs"))
