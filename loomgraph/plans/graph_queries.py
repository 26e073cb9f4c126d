"""Queries over the property graph: checks, upserts, browsing, retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from ..operators import answer as A
from ..operators import graph as G
from ..operators import retrieve as R
from ..operators import validate as V
from ..shared import kept
from .tables import GRAPH_SQL, QUESTIONS_SQL, edges, node_id, nodes, questions, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DIRECTIONS_SQL = "rules(type, st, tt) AS (VALUES " + ", ".join(f"('{r}', '{s}', '{t}')" for r, pairs in dims.DIRECTIONS.items() for s, t in pairs) + ")"


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


@query("graph_counts", f"WITH {GRAPH_SQL} SELECT 'node' AS kind, label, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.counts(nodes(spark, sf_dir), edges(spark, sf_dir))


@query("graph_nodes", f"WITH {GRAPH_SQL} SELECT DISTINCT nodes.id, label, name FROM nodes JOIN plain ON nodes.id = plain.src OR nodes.id = plain.dst")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.row_graph(G.triples(edges(spark, sf_dir).where("type <> 'MENTIONS'"), nodes(spark, sf_dir)).withColumn("pos", F.xxhash64("id")))


@query("graph_edges", f"WITH {GRAPH_SQL} SELECT e.id, e.type, s.name AS src_name, s.label AS src_label, t.name AS dst_name, t.label AS dst_label FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.triples(edges(spark, sf_dir), nodes(spark, sf_dir)).select("id", "type", "src_name", "src_label", "dst_name", "dst_label")


@query(
    "direction_check",
    f"WITH {GRAPH_SQL}, {DIRECTIONS_SQL}, e AS (SELECT e.id, e.type, s.label AS sl, t.label AS tl FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id) SELECT e.type, sl AS src_label, tl AS dst_label, count(*) AS n, count(rules.type) AS n_valid FROM e LEFT JOIN rules ON rules.type = e.type AND st = sl AND tt = tl GROUP BY e.type, sl, tl",
)
def direction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.broadcast(dims.directions(spark).select(F.col("type").alias("_ty"), F.col("source_type").alias("_s"), F.col("target_type").alias("_t")))
    e = G.triples(edges(spark, sf_dir), nodes(spark, sf_dir)).join(rules, (F.col("type") == F.col("_ty")) & (F.col("src_label") == F.col("_s")) & (F.col("dst_label") == F.col("_t")), "left")
    return e.groupBy("type", "src_label", "dst_label").agg(F.count("*").alias("n"), F.count("_ty").alias("n_valid"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw relationships, some of them faulty."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 7, "cures").when(F.col("l_returnflag") == "R", " treats").when(F.col("l_returnflag") == "A", "REDUCES").otherwise("associated_with")
    return li.select(
        F.col("l_orderkey").alias("doc"), node_id("PMC", "l_orderkey").alias("pmcid"), node_id("c", "l_linenumber").alias("chunk_id"), kind.alias("type"), F.lit("drug").alias("s_type"), node_id("part ", "l_partkey").alias("s_name"),
        F.when(F.col("l_quantity") > 45, "Paper ").otherwise("CONDITION").alias("t_type"), F.when(F.col("l_quantity") < 3, "").otherwise(node_id("supplier ", "l_suppkey")).alias("t_name"),
        F.when(F.col("l_tax") == 0.08, F.lit("high")).otherwise((F.round(F.col("l_discount") * 10, 2)).cast("string")).alias("confidence"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("line "), F.col("l_suppkey"))).otherwise(F.when(F.col("l_quantity") > 5, "seen").otherwise(" ")).alias("evidence"),
    )


_RAW_SQL = """raw AS (SELECT l_orderkey AS doc, 'PMC' || l_orderkey AS pmcid, 'c' || l_linenumber AS chunk_id,
  CASE WHEN l_linenumber = 7 THEN 'CURES' WHEN l_returnflag = 'R' THEN 'TREATS' WHEN l_returnflag = 'A' THEN 'REDUCES' ELSE 'ASSOCIATED_WITH' END AS type, 'Drug' AS st, 'part ' || l_partkey AS sn,
  CASE WHEN l_quantity > 45 THEN 'Paper' ELSE 'Condition' END AS tt, CASE WHEN l_quantity < 3 THEN '' ELSE 'supplier ' || l_suppkey END AS tn,
  CASE WHEN l_tax = 0.08 THEN NULL ELSE round(l_discount * 10, 2) END AS conf, CASE WHEN l_linestatus = 'F' THEN 'line ' || l_suppkey WHEN l_quantity > 5 THEN 'seen' ELSE '' END AS evidence FROM lineitem),
checked AS (SELECT raw.*, CASE WHEN type NOT IN (SELECT type FROM rules) THEN 'relationship type is not in the ontology' WHEN tt <> 'Paper' AND tn = '' THEN 'relationship endpoint is invalid'
  WHEN NOT EXISTS (SELECT 1 FROM rules r WHERE r.type = raw.type AND r.st = raw.st AND r.tt = raw.tt) THEN 'relationship direction is invalid for the ontology' WHEN conf IS NULL THEN 'relationship confidence is missing or invalid'
  WHEN evidence = '' THEN 'relationship evidence is required' WHEN conf < 0.5 OR conf > 1 THEN 'relationship confidence is outside the accepted range' END AS reason FROM raw)"""


@query("reject_reasons", f"WITH {DIRECTIONS_SQL}, {_RAW_SQL} SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY reason")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.relationships(_raw(spark, sf_dir))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "valid_relationships",
    f"WITH {DIRECTIONS_SQL}, {_RAW_SQL}, k AS (SELECT doc, type, conf, 'drug:' || trim(regexp_replace(lower(sn), '[^a-z0-9]+', '_', 'g'), '_') AS src, 'condition:' || trim(regexp_replace(lower(tn), '[^a-z0-9]+', '_', 'g'), '_') AS dst, pmcid, chunk_id, evidence FROM checked WHERE reason IS NULL) "
    "SELECT DISTINCT doc, 'rel:' || sha1(src || '|' || type || '|' || dst || '|' || pmcid || '|' || chunk_id || '|' || evidence) AS id, type, src, dst FROM k",
)
def valid_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.relationships(_raw(spark, sf_dir))[0].select("doc", "id", "type", "src", "dst")


@query(
    "upsert_nodes",
    "WITH n AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderpriority AS priority, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS status FROM orders), "
    "a AS (SELECT c_custkey AS id, -1 AS seq, c_mktsegment AS segment, NULL AS priority, 'old' AS status FROM customer UNION ALL SELECT id, seq, NULL, priority, status FROM n) "
    "SELECT id, max(segment) AS segment, arg_max(priority, seq) AS priority, arg_max(status, seq) AS status FROM a GROUP BY id",
)
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda: F.lit(None).cast("string")
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("seq"), F.col("c_mktsegment").alias("segment"), text().alias("priority"), F.lit("old").alias("status"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), text().alias("segment"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    return G.upsert(old, new, ["id"], "seq").select("id", "segment", "priority", "status")


@query(
    "upsert_edges",
    "WITH s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0), p AS (SELECT p_partkey FROM part WHERE p_size > 10) SELECT count(*) AS attempted, count(*) FILTER (WHERE l_suppkey IN (SELECT s_suppkey FROM s) AND l_partkey IN (SELECT p_partkey FROM p)) AS written FROM lineitem",
)
def upsert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.lit("TREATS").alias("type"), node_id("p", "l_partkey").alias("src"), node_id("s", "l_suppkey").alias("dst"))
    n = table(spark, sf_dir, "part").where("p_size > 10").select(node_id("p", "p_partkey").alias("id")).unionByName(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(node_id("s", "s_suppkey").alias("id")))
    return G.attach(e, n)[1]


@query("mentions_edges", "SELECT DISTINCT 'rel:' || sha1('paper:' || l_orderkey || '|MENTIONS|drug:' || l_partkey || '|PMC' || l_orderkey) AS id, 'MENTIONS' AS type, 'paper:' || l_orderkey AS src, 'drug:' || l_partkey AS dst FROM lineitem")
def mentions_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mention_edges(table(spark, sf_dir, "lineitem").select(node_id("paper:", "l_orderkey").alias("paper"), node_id("drug:", "l_partkey").alias("entity"), node_id("PMC", "l_orderkey").alias("pmcid")))


@query("tagged_delete", f"WITH {GRAPH_SQL}, kept AS (SELECT * FROM nodes WHERE NOT (label = 'Drug' AND name LIKE 'red%')) SELECT (SELECT count(*) FROM kept) AS n_nodes, count(*) AS n_edges FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)")
def tagged_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = G.without(nodes(spark, sf_dir), edges(spark, sf_dir), (F.col("label") == "Drug") & F.col("name").startswith("red"))
    tally = lambda rows, a, b: rows.select(F.lit(a).alias("n_nodes"), F.lit(b).alias("n_edges"))
    return tally(n, 1, 0).unionByName(tally(e, 0, 1)).agg(F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"))


@query("unique_violations", "SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unique_violations(table(spark, sf_dir, "part"), "p_name")


@query("metadata_completeness", "SELECT f AS field, count(*) AS total, count(*) FILTER (WHERE v <> '') AS complete, count(*) - count(*) FILTER (WHERE v <> '') AS missing FROM (SELECT unnest(['k', 'x', 'event_type']) AS f, unnest([coalesce(props ->> '$.k', ''), coalesce(props ->> '$.x', ''), coalesce(event_type, '')]) AS v FROM events) GROUP BY f")
def metadata_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.completeness(table(spark, sf_dir, "events"), {"k": F.get_json_object("props", "$.k"), "x": F.get_json_object("props", "$.x"), "event_type": F.col("event_type")})


@query("source_runs", "SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS runs FROM documents WHERE source <> ''")
def source_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.source_runs(table(spark, sf_dir, "documents"), "source").select(F.array_join("runs", ",").alias("runs"))


_PLAIN = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_\\s-]', ' ', 'g'), '[-_\\s]+', ' ', 'g'))"
_STOP = ", ".join(f"'{t}'" for t in dims.STOP_TERMS)
_ANCHORS_SQL = f"""{QUESTIONS_SQL}, qn AS (SELECT q, {_PLAIN.format("question")} AS n FROM questions),
term AS (SELECT DISTINCT q, t FROM (SELECT q, unnest(string_split(n, ' ')) AS t FROM qn) WHERE length(t) >= 3 AND t NOT IN ({_STOP})),
word AS (SELECT DISTINCT id, name, w FROM (SELECT id, name, unnest(string_split({_PLAIN.format("name")}, ' ')) AS w FROM nodes WHERE label <> 'Paper')),
anchor AS (SELECT q, id FROM (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY hits DESC, name, id) AS r FROM (SELECT q, id, name, count(*) AS hits FROM word JOIN term ON w = t GROUP BY q, id, name)) WHERE r <= 25),
want AS (SELECT q, CASE WHEN contains(n, 'risk') OR contains(n, 'predispose') THEN ['INCREASES_RISK_OF', 'MAY_INCREASE_RISK_OF'] WHEN contains(n, 'reduce') OR contains(n, 'lower') OR contains(n, 'decrease') THEN ['REDUCES', 'MAY_REDUCE']
  WHEN contains(n, 'increase') OR contains(n, 'raise') OR contains(n, 'elevate') THEN ['INCREASES', 'MAY_INCREASE', 'INCREASES_RISK_OF', 'MAY_INCREASE_RISK_OF'] WHEN contains(n, 'treat') OR contains(n, 'therapy') THEN ['TREATS']
  WHEN contains(n, 'interact') OR contains(n, 'combination') THEN ['INTERACTS_WITH', 'MAY_INTERACT_WITH'] ELSE [] END AS types, contains(n, 'connect') OR contains(n, 'path') OR contains(n, 'through') OR contains(n, 'multi hop') AS wants_path FROM qn)"""


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The analysed questions, and their anchors with the types asked for."""
    q = R.analysed(questions(spark))
    return q, R.anchors(q, nodes(spark, sf_dir)).join(q.select("q", "types", "wants_path"), "q")


@query("question_intents", f"WITH {GRAPH_SQL}, {_ANCHORS_SQL} SELECT want.q, array_to_string(types, ',') AS types, wants_path, coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM term WHERE term.q = want.q), '') AS terms FROM want")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.analysed(questions(spark)).select("q", F.array_join("types", ",").alias("types"), "wants_path", F.array_join("terms", ",").alias("terms"))


@query("anchors", f"WITH {GRAPH_SQL}, {_ANCHORS_SQL} SELECT q, id FROM anchor")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir)[1].select("q", "id")


@query("direct_paths", f"WITH {GRAPH_SQL}, {_ANCHORS_SQL} SELECT DISTINCT a.q, p.id AS rel FROM anchor a JOIN want ON want.q = a.q JOIN plain p ON (p.src = a.id OR p.dst = a.id) AND (len(types) = 0 OR list_contains(types, p.type))")
def direct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.direct_paths(_asked(spark, sf_dir)[1], edges(spark, sf_dir)).select("q", F.get("rels", F.lit(0)).alias("rel"))


@query(
    "two_hop_paths",
    f"""WITH {GRAPH_SQL}, {_ANCHORS_SQL}, np AS (SELECT id FROM nodes WHERE label <> 'Paper'), s AS (SELECT DISTINCT a.id FROM anchor a JOIN want ON want.q = a.q WHERE wants_path),
x AS (SELECT s.id AS start, f.v AS mid, f.id AS first, g.id AS second, g.v AS finish, f.confidence AS c1, g.confidence AS c2 FROM s JOIN sym f ON f.u = s.id JOIN sym g ON g.u = f.v WHERE f.id <> g.id AND g.v <> s.id AND f.v IN (SELECT id FROM np) AND g.v IN (SELECT id FROM np))
SELECT start, finish, count(*) AS n_paths, max(least(c1, c2)) AS best FROM x GROUP BY start, finish""",
)
def two_hop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = _asked(spark, sf_dir)[1].where("wants_path").select("id").distinct()
    found = G.two_hop(starts, edges(spark, sf_dir), nodes(spark, sf_dir))
    return found.groupBy("start", "finish").agg(F.count("*").alias("n_paths"), F.max(F.least("c1", "c2")).alias("best"))


@query(
    "drug_connectors",
    f"""WITH {GRAPH_SQL}, grp(q, g, id) AS (SELECT 1, 0, 'condition:' || s_suppkey FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 1, 1, 'condition:' || s_suppkey FROM supplier WHERE s_nationkey = 7),
arm AS (SELECT q, g, u AS drug, sym.id AS edge, coalesce(confidence, 0) AS c FROM sym JOIN grp ON grp.id = sym.v WHERE u LIKE 'drug:%'),
x AS (SELECT a.q, a.g AS g1, b.g AS g2, a.drug, a.edge AS first, b.edge AS second, round(a.c + b.c, 6) AS total FROM arm a JOIN arm b ON a.q = b.q AND a.drug = b.drug AND a.g < b.g AND a.edge <> b.edge)
SELECT * FROM (SELECT q, g1, g2, drug, first, second, total, CAST(row_number() OVER (PARTITION BY q ORDER BY total DESC, first, second) AS INT) AS rank FROM x) WHERE rank <= 100""",
)
def drug_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_nationkey in (3, 7)")
    groups = s.select(F.lit(1).alias("q"), F.when(F.col("s_nationkey") == 3, 0).otherwise(1).alias("g"), node_id("condition:", "s_suppkey").alias("id"))
    return R.connectors(groups, edges(spark, sf_dir), nodes(spark, sf_dir))


_LEGACY = "does small ring help in supplier#000000004 or nation_2"


@query(
    "legacy_retrieval",
    f"""WITH {GRAPH_SQL}, f AS (SELECT e.id, s.name AS src_name, e.type, t.name AS dst_name, e.confidence, e.source_pmcid, e.src FROM plain e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id WHERE contains('{_LEGACY}', lower(s.name)) OR contains('{_LEGACY}', lower(t.name))),
x AS (SELECT DISTINCT f.id, src_name, f.type, dst_name, f.confidence, coalesce(p.id, m.src, '') AS document_id FROM f LEFT JOIN (SELECT id, 'PMC' || substring(id, 7) AS pmcid FROM nodes WHERE label = 'Paper') p ON p.pmcid = f.source_pmcid LEFT JOIN (SELECT src, dst FROM edges WHERE type = 'MENTIONS') m ON m.dst = f.src)
SELECT id, src_name, type, dst_name, confidence, document_id FROM x ORDER BY confidence DESC NULLS FIRST, id, document_id LIMIT 50""",
)
def legacy_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).withColumn("pmcid", F.when(F.col("label") == "Paper", F.concat(F.lit("PMC"), F.substr("id", F.lit(7)))))
    return R.legacy(_LEGACY, edges(spark, sf_dir), n, 50)


def _around(spark: SparkSession, sf_dir: str, hops: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored paths of the questions, and the edges and nodes that they can hold."""
    q, starts = _asked(spark, sf_dir)
    starts = kept(starts)
    e, n = G.neighbourhood(starts, edges(spark, sf_dir), nodes(spark, sf_dir), starts.where("wants_path") if hops else None)
    paths = R.direct_paths(starts, e)
    if hops:
        paths = paths.unionByName(R.two_hop_paths(starts.where("wants_path"), e, n)).distinct()
    return R.scored(kept(paths), e, n, q), e, n


def _scored(spark: SparkSession, sf_dir: str, hops: bool) -> DataFrame:
    return _around(spark, sf_dir, hops)[0]


_SCORES_SQL = f"""WITH {GRAPH_SQL}, {_ANCHORS_SQL},
x AS (SELECT DISTINCT a.q, p.id AS rel, p.type, p.confidence, s.name AS sn, t.name AS tn FROM anchor a JOIN want ON want.q = a.q JOIN plain p ON (p.src = a.id OR p.dst = a.id) AND (len(types) = 0 OR list_contains(types, p.type)) JOIN nodes s ON p.src = s.id JOIN nodes t ON p.dst = t.id),
tn AS (SELECT q, count(*) AS k FROM term GROUP BY q),
y AS (SELECT x.*, k, n, (SELECT count(*) FROM term WHERE term.q = x.q AND contains({_PLAIN.format("sn || ' ' || tn")}, t)) AS h1, (SELECT count(*) FROM term WHERE term.q = x.q AND contains({_PLAIN.format("sn || ' ' || tn || ' ' || type")}, t)) AS h2 FROM x JOIN tn ON tn.q = x.q JOIN qn ON qn.q = x.q),
z AS (SELECT q, rel, confidence AS best, round(0.20 * least(1.0, h1 / least(k, 6)) + 0.30 + 0.25 * least(1.0, h2 / least(k, 6))
  + 0.15 * CASE WHEN type = 'TREATS' AND (contains(n, 'treat') OR contains(n, 'therapy') OR contains(n, 'indicated')) OR type = 'PREVENTS' AND (contains(n, 'prevent') OR contains(n, 'risk reduction') OR contains(n, 'protect')) OR type = 'ASSOCIATED_WITH' AND (contains(n, 'associate') OR contains(n, 'linked') OR contains(n, 'mark') OR contains(n, 'present')) THEN 1 ELSE 0 END
  + 0.15 * CASE WHEN type = 'ASSOCIATED_WITH' AND (contains(n, 'lipid') OR contains(n, 'biomarker') OR contains(n, 'cholesterol') OR contains(n, 'triglyceride') OR contains(n, 'drug')) THEN -0.5 ELSE 0 END
  + 0.10 * coalesce(confidence, 0) + 0.03, 6) AS score FROM y)
"""


@query("path_scores", _SCORES_SQL + "SELECT q, rel, score FROM z")
def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, False).select("q", F.get("rels", F.lit(0)).alias("rel"), "score")


@query("top_paths", _SCORES_SQL + "SELECT q, rel, score, CAST(r AS INT) AS rank FROM (SELECT q, rel, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, coalesce(best, 0) DESC, 'path:' || sha1(rel)) AS r FROM z) WHERE r <= 12")
def top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_paths(_scored(spark, sf_dir, False), 12).select("q", F.get("rels", F.lit(0)).alias("rel"), "score", "rank")


_RELATED = " OR ".join("type = '" + t + "' AND (" + " OR ".join(f"contains(n, '{c}')" for c in cues) + ")" for t, cues in dims.RELEVANCE_CUES.items())
_LIPIDS = " OR ".join(f"contains(n, '{c}')" for c in dims.LIPID_CUES)
#: One- and two-step paths with their scores and order; then the greedy choice, a path a round.
_PATHS_SQL = f"""WITH RECURSIVE {GRAPH_SQL}, {_ANCHORS_SQL}, np AS (SELECT id FROM nodes WHERE label <> 'Paper'),
path AS (SELECT a.q, [p.id] AS rels FROM anchor a JOIN want ON want.q = a.q JOIN plain p ON (p.src = a.id OR p.dst = a.id) AND (len(types) = 0 OR list_contains(types, p.type))
  UNION SELECT a.q, [f.id, g.id] FROM anchor a JOIN want ON want.q = a.q AND wants_path JOIN sym f ON f.u = a.id JOIN sym g ON g.u = f.v WHERE f.id <> g.id AND g.v <> a.id AND f.v IN (SELECT id FROM np) AND g.v IN (SELECT id FROM np) AND (len(types) = 0 OR list_contains(types, f.type) OR list_contains(types, g.type))),
told AS (SELECT term.q, n, list(t) AS ts, least(count(*), 6) AS k FROM term JOIN qn ON qn.q = term.q GROUP BY term.q, n),
fact AS (SELECT *, least(1.0, len(list_filter(ts, lambda t: contains(said, t))) / k) AS ov, CASE WHEN {_RELATED} THEN 1.0 ELSE 0.0 END AS rel FROM (
  SELECT d.q, d.edge, p.type, coalesce(p.confidence, 0) AS c, {_PLAIN.format("s.name || ' ' || t.name")} AS ends, {_PLAIN.format("s.name || ' ' || t.name || ' ' || p.type")} AS said, s.label = 'Drug' OR t.label = 'Drug' AS drug, told.n, ts, k
  FROM (SELECT DISTINCT q, unnest(rels) AS edge FROM path) d JOIN plain p ON p.id = d.edge JOIN nodes s ON s.id = p.src JOIN nodes t ON t.id = p.dst JOIN told ON told.q = d.q)),
scores AS (SELECT x.q, x.rels, greatest(a.c, b.c) AS best, round(0.20 * least(1.0, len(list_filter(a.ts, lambda t: contains(concat_ws(' ', a.ends, b.ends), t))) / a.k) + 0.30 + 0.25 * greatest(a.ov, b.ov) + 0.15 * greatest(a.rel, b.rel)
  + 0.15 * CASE WHEN a.lipids AND a.type = 'ASSOCIATED_WITH' AND coalesce(b.type, a.type) = a.type THEN -0.5 ELSE 0.0 END + 0.10 * least(a.c, b.c) + CASE WHEN b.q IS NULL THEN 0.03 ELSE 0.08 END + CASE WHEN b.q IS NULL OR NOT contains(a.n, 'drug') THEN 0.0 WHEN a.drug OR b.drug THEN 0.25 ELSE -0.10 END, 6) AS score
  FROM path x JOIN (SELECT *, {_LIPIDS} AS lipids FROM fact) a ON a.q = x.q AND a.edge = x.rels[1] LEFT JOIN fact b ON b.q = x.q AND b.edge = x.rels[2]),
rk AS (SELECT q, rels, score, 'path:' || sha1(array_to_string(rels, '|')) AS path_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, best DESC, len(rels), 'path:' || sha1(array_to_string(rels, '|'))) AS r FROM scores),
pk AS (SELECT DISTINCT q, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS used, 0 AS m FROM rk
  UNION ALL SELECT q, r, used, m FROM (SELECT pk.q, rk.r, list_concat(pk.used, rk.rels) AS used, pk.m + 1 AS m, row_number() OVER (PARTITION BY pk.q ORDER BY rk.r) AS o FROM pk JOIN rk ON rk.q = pk.q AND rk.r > pk.r AND NOT list_has_any(pk.used, rk.rels) AND len(pk.used) + len(rk.rels) <= 9) WHERE o = 1),
chosen AS (SELECT rk.q, path_id, rels, score, m AS rank FROM pk JOIN rk ON rk.q = pk.q AND rk.r = pk.r WHERE m > 0)
"""


@query("all_path_scores", _PATHS_SQL + "SELECT q, len(rels) AS length, score, count(*) AS n FROM scores GROUP BY q, len(rels), score")
def all_path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, True).groupBy("q", "length", "score").agg(F.count("*").alias("n"))


@query("packed_evidence", _PATHS_SQL + "SELECT q, path_id, array_to_string(rels, '|') AS rels, len(rels) AS length, score, rank FROM chosen")
def packed_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.packed(_scored(spark, sf_dir, True), R.budgets(12)[1]).select("q", "path_id", F.array_join("rels", "|").alias("rels"), "length", "score", "rank")


#: A stated terminology: concepts to be covered, and entries with a definition.
CONCEPTS = [(0, "red widget", ["000000003"]), (1, "Supplier 000000007", ["000000007", "the"]), (2, "nowhere at all", ["never"])]
ENTRIES = [(10, "small ring", ["little ring"], "A ring of little size."), (11, "blue bolt", [], "A bolt that is blue."), (12, "Treat", [], "To care for.")]
_VALUES = ", ".join(f"({c}, {[' '.join(x.lower().replace('-', ' ').split()) for x in (name, *more)]})" for c, name, more, *_ in [*CONCEPTS, *ENTRIES])
_ENTRIES = ", ".join(f"({c}, '{name}', '{text}')" for c, name, _, text in ENTRIES)
_LEFT = "least(greatest(12 // 3, 0), 3)"
_EVIDENCE_SQL = (
    _PATHS_SQL.replace(
        "term AS (SELECT DISTINCT q, t FROM (SELECT q, unnest(string_split(n, ' ')) AS t FROM qn) WHERE length(t) >= 3 AND",
        f"""concept(c, vals) AS (VALUES {_VALUES}), entry(c, name, definition) AS (VALUES {_ENTRIES}),
grp AS (SELECT q, c, vals FROM qn, concept WHERE len(list_filter(vals, lambda v: contains(' ' || n || ' ', ' ' || v || ' '))) > 0),
def AS (SELECT * FROM (SELECT q, name, definition, row_number() OVER (PARTITION BY q ORDER BY entry.c) AS o FROM grp JOIN entry ON entry.c = grp.c) WHERE o <= {_LEFT}),
lim AS (SELECT q, 12 - (SELECT count(*) FROM def WHERE def.q = qn.q) AS budget FROM qn),
term AS (SELECT DISTINCT q, t FROM (SELECT q, t FROM (SELECT q, unnest(string_split(n, ' ')) AS t FROM qn) WHERE length(t) >= 3 UNION ALL SELECT q, unnest(vals) FROM grp) WHERE""",
    )
    .replace("FROM word JOIN term ON w = t GROUP BY", "FROM word JOIN (SELECT DISTINCT q, unnest(string_split(t, ' ')) AS t FROM term) ON w = t GROUP BY")
    .replace(
        "path AS (SELECT a.q, [p.id]",
        f"""member AS (SELECT DISTINCT q, c, id FROM nodes JOIN (SELECT q, c, unnest(vals) AS v FROM grp) ON name <> '' AND v NOT IN ({_STOP}) AND (contains(lower(name), v) OR contains(v, lower(name)))),
arm AS (SELECT member.q, c, u, sym.id, coalesce(confidence, 0) AS k FROM member JOIN want ON want.q = member.q AND wants_path JOIN qn ON qn.q = member.q AND contains(n, 'drug') JOIN sym ON sym.v = member.id WHERE u LIKE 'drug:%'),
link AS (SELECT q, [x, y] AS rels FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY total DESC, x, y) AS r FROM (SELECT a.q, a.id AS x, b.id AS y, round(a.k + b.k, 6) AS total FROM arm a JOIN arm b ON a.q = b.q AND a.u = b.u AND a.c < b.c AND a.id <> b.id)) WHERE r <= 100),
path AS (SELECT q, rels FROM link UNION SELECT a.q, [p.id]""",
    )
    .replace("+ 0.30 + 0.25 *", "+ 0.30 * cov + 0.25 *")
    .replace("CASE WHEN b.q IS NULL THEN 0.03 ELSE 0.08 END", "CASE WHEN b.q IS NULL THEN 0.03 WHEN NOT asks THEN -0.05 WHEN cov < 1 THEN -0.17 ELSE 0.08 END")
    .replace(
        "FROM path x JOIN (SELECT",
        "FROM (SELECT path.*, want.wants_path AS asks, coalesce((SELECT count(*) FILTER (WHERE len(list_filter(vals, lambda v: contains(said.ends, v))) > 0) / count(*) FROM grp WHERE grp.q = path.q HAVING count(*) > 0), 1.0) AS cov FROM path JOIN want ON want.q = path.q JOIN (SELECT p.q, p.rels, concat_ws(' ', a.ends, b.ends) AS ends FROM path p JOIN fact a ON a.q = p.q AND a.edge = p.rels[1] LEFT JOIN fact b ON b.q = p.q AND b.edge = p.rels[2]) said ON said.q = path.q AND said.rels = path.rels) x JOIN (SELECT",
    )
    .replace("len(pk.used) + len(rk.rels) <= 9", "len(pk.used) + len(rk.rels) <= (SELECT budget FROM lim WHERE lim.q = pk.q)")
)


@query(
    "graph_evidence",
    _EVIDENCE_SQL
    + f""", out AS (SELECT chosen.q, 0 AS late, rank * 10 + i AS o, 'graph' AS kind, rels[i] AS id, path_id, i AS path_step, len(rels) AS path_length, score AS match_score, s.name AS source, p.type, t.name AS target, p.confidence, '' AS text
  FROM chosen JOIN (VALUES (1), (2)) v(i) ON i <= len(rels) JOIN plain p ON p.id = rels[i] JOIN nodes s ON s.id = p.src JOIN nodes t ON t.id = p.dst
  UNION ALL SELECT q, 1, o, 'definition', 'definition:' || substring(sha1(name), 1, 16), '', 1, 1, 1.0, name, 'DEFINITION_OF', '', 1.0, definition FROM def)
SELECT q, CAST(row_number() OVER (PARTITION BY q ORDER BY late, o) AS INT) AS pos, kind, id, path_id, path_step, path_length, match_score, source, type, target, confidence, text FROM out""",
)
def graph_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole graph retriever: definitions, anchors, paths, connectors, scores and packing."""
    concepts = spark.createDataFrame(CONCEPTS, "c int, name string, aliases array<string>")
    entries = spark.createDataFrame(ENTRIES, "c int, name string, aliases array<string>, definition string")
    return R.evidence(questions(spark), nodes(spark, sf_dir), edges(spark, sf_dir), concepts, entries, 12)


_TOLD = "CASE " + " ".join("WHEN type IN (" + ", ".join(f"'{x}'" for x in types) + ") THEN " + f"replace(replace(replace('{text}', '{{s}}', s), '{{t}}', t), '{{r}}', type)" for types, text in dims.SENTENCES[:-1])
_TOLD += f" ELSE replace(replace(replace('{dims.SENTENCES[-1][1]}', '{{s}}', s), '{{t}}', t), '{{r}}', type) END"


@query(
    "answers",
    _PATHS_SQL
    + f""", step AS (SELECT q, rank * 10 + i AS pos, rels[i] AS edge FROM chosen, (VALUES (1), (2)) v(i) WHERE i <= len(rels)),
ev AS (SELECT step.q, pos, p.type, s.name AS s, t.name AS t, p.confidence FROM step JOIN plain p ON p.id = edge JOIN nodes s ON s.id = p.src JOIN nodes t ON t.id = p.dst),
one AS (SELECT *, row_number() OVER (PARTITION BY q, {_PLAIN.format("s")}, type, {_PLAIN.format("t")} ORDER BY pos) AS o FROM ev)
SELECT questions.q, coalesce(string_agg({_TOLD}, ' ' ORDER BY pos), '{dims.ABSTAINED}') AS answer, CASE WHEN count(pos) = 0 THEN 'abstained' ELSE 'summary' END AS mode, coalesce(min(confidence), 0.0) AS confidence, count(pos) = 0 AS abstained FROM questions LEFT JOIN one ON one.q = questions.q AND o = 1 GROUP BY questions.q""",
)
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered from their packed paths, without a model."""
    paths, e, n = _around(spark, sf_dir, True)
    chosen = R.packed(paths, R.budgets(12)[1])
    steps = chosen.select("q", "rank", "path_id", "length", F.posexplode("rels").alias("step", "edge"))
    facts = G.triples(e.withColumnRenamed("id", "edge"), n)
    ev = steps.join(facts, "edge").select("q", (F.col("rank") * 10 + F.col("step")).alias("pos"), F.col("edge").alias("id"), F.col("src_name").alias("source"), "type", F.col("dst_name").alias("target"), F.col("dst_label").alias("target_label"), F.lit("graph").alias("kind"), "confidence")
    return A.answers(questions(spark), ev)


@query(
    "browse_graph",
    f"""WITH {GRAPH_SQL}, page AS (SELECT id, label, name FROM nodes WHERE contains(lower(name), 'supplier#00000000') OR contains(lower(id), 'supplier#00000000') ORDER BY name, id LIMIT 20),
near AS (SELECT DISTINCT id, type, src, dst FROM edges WHERE src IN (SELECT id FROM page) OR dst IN (SELECT id FROM page)), e AS (SELECT * FROM near ORDER BY id LIMIT 60)
SELECT id, label, name FROM (SELECT * FROM page UNION SELECT * FROM nodes WHERE id IN (SELECT src FROM e UNION SELECT dst FROM e)) ORDER BY id LIMIT 80""",
)
def browse_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.browse(nodes(spark, sf_dir), edges(spark, sf_dir), q="Supplier#00000000", limit=20)[0]


@query(
    "evidence_dedupe",
    "SELECT l_orderkey AS q, l_linenumber AS pos, 'part ' || l_partkey % 10 AS source, l_returnflag AS type FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 10, l_returnflag, l_suppkey % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1",
)
def evidence_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"), F.concat(F.lit("part "), F.col("l_partkey") % 10).alias("source"), F.col("l_returnflag").alias("type"), F.concat(F.lit("supplier-"), F.col("l_suppkey") % 2).alias("target"), F.lit("graph").alias("kind"))
    return A.deduplicated(li).select("q", F.col("pos.l_linenumber").alias("pos"), "source", "type")


@query("relation_sentences", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'R' THEN 'part ' || l_partkey || ' treats supplier ' || l_suppkey || '.' WHEN 'A' THEN 'part ' || l_partkey || ' may reduce supplier ' || l_suppkey || '.' ELSE 'part ' || l_partkey || ' is connected to supplier ' || l_suppkey || ' by N.' END AS sentence FROM lineitem")
def relation_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "TREATS").when(F.col("l_returnflag") == "A", "MAY_REDUCE").otherwise("N")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.sentence(kind, node_id("part ", "l_partkey"), node_id("supplier ", "l_suppkey")).alias("sentence"))


@query(
    "load_report",
    f"""WITH {GRAPH_SQL} SELECT 'run-1' AS graph_run_id, 'local' AS graph_source, 'then' AS loaded_at, (SELECT count(DISTINCT x) FROM (SELECT label AS x FROM nodes UNION ALL SELECT type FROM edges)) AS files, (SELECT count(*) FROM nodes WHERE label <> 'Paper') AS entities,
count(*) AS relationships, 0 AS complete, 0 AS missing_id, count(*) AS missing_evidence, count(*) FILTER (WHERE confidence IS NULL) AS missing_confidence, count(*) FILTER (WHERE source_pmcid = '') AS missing_source_pmcid, count(*) AS missing_chunk_id FROM plain""",
)
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and types stand for the files of a load."""
    return G.load_report(nodes(spark, sf_dir).withColumn("file", F.col("label")), edges(spark, sf_dir).withColumn("file", F.col("type")), "run-1", "local", "then")


@query("name_lists", "WITH g AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY n_regionkey) SELECT n_regionkey, CASE WHEN len(l) = 1 THEN l[1] WHEN len(l) = 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END AS names FROM g")
def name_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l")).select("n_regionkey", T.join_names(F.col("l")).alias("names"))


@query(
    "reasoning_groups",
    "WITH s AS (SELECT conv_id, turn, role, min(turn) OVER (PARTITION BY conv_id, role) AS f FROM conversations) SELECT conv_id, turn, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS INT) AS path_order, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY f, turn) AS INT) AS step_order FROM s",
)
def reasoning_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("path_id"), F.lit("").alias("id"), F.col("turn").alias("path_step"))
    return A.reasoning(c, "conv_id").select("conv_id", F.col("pos").alias("turn"), "path_order", "step_order")
