"""Queries over the records of runs: scores of questions, results of chunks, evidence from loose records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, retrieve
from ..operators import question_scores as S
from .tables import node_id, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _run(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Orders as questions with their manifest and answers, line items as evidence and sources."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: F.lit(x).cast("string")
    meta = {
        "expected_hop_count": (c % 4).cast("string"), "unanswerable": F.when(c % 11 == 0, "true").otherwise("false"), "required_evidence_kinds": F.when(c % 2 == 0, '["definition","Graph"]').otherwise(""),
        "requires_graph_evidence": F.when(c % 5 == 0, "yes"), "expected_chunk_ids": F.when(c % 6 == 0, "c1; c2"), "category": F.col("o_orderstatus"), "split": F.lit(" dev "),
    }
    questions = o.select(
        node_id("q", "o_orderkey").alias("id"), node_id("order ", "o_orderkey").alias("question"), F.array("o_orderpriority", F.concat(F.lit("the "), "o_orderstatus", F.lit(" part"))).alias("facts"),
        F.array(F.concat(F.lit("Part_"), c % 7), F.concat(F.lit("supplier "), c % 5), F.lit("")).alias("entities"),
        F.when(c % 3 == 0, F.array().cast("array<string>")).when(c % 3 == 1, F.array(F.lit("treats"))).otherwise(F.array(F.lit("TREATS"), F.lit("associated_with"))).alias("relationships"),
        F.create_map(*[x for n, v in meta.items() for x in (F.lit(n), v)]).alias("metadata"),
    )
    manifest = o.where(k % 9 != 0).select(
        node_id("q", "o_orderkey").alias("id"), F.when(k % 8 == 0, "error").otherwise("ok").alias("status"), F.when(k % 10 == 0, "skipped").otherwise("ok").alias("answer_status"),
        (k % 5).cast("string").alias("retrieved_count"), text("").alias("source_count"), F.when(k % 6 == 0, "True").otherwise("no").alias("abstained"), F.when(k % 8 == 0, "late").alias("error"),
    )
    said = F.concat(F.lit("Priority "), "o_orderpriority", F.lit(" is the part "), F.when(k % 3 == 0, F.col("o_orderstatus")).otherwise("x"))
    answers = o.where(k % 4 != 0).select(node_id("q", "o_orderkey").alias("id"), F.when(k % 14 == 0, "").otherwise(said).alias("answer"), (k % 7 == 0).alias("abstained"))
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    kind = F.when(F.col("l_linestatus") == "O", "Definition").otherwise("graph").alias("evidence_kind")
    evidence = li.where("l_partkey % 5 <> 0").select(
        node_id("q", "l_orderkey").alias("q"), node_id("e", "l_linenumber").alias("id"), node_id("c", "l_linenumber").alias("chunk_id"), text("").alias("relationship_id"),
        F.concat(F.lit("PART "), F.col("l_partkey") % 7).alias("source_name"), F.when(F.col("l_returnflag") == "R", "TREATS").when(F.col("l_returnflag") == "A", "PREVENTS").otherwise("ASSOCIATED_WITH").alias("relationship_type"),
        F.concat(F.lit("Supplier  "), F.col("l_suppkey") % 5).alias("target_name"), F.when(n <= 4, F.concat(F.lit("p"), F.expr("(l_linenumber + 1) div 2"))).alias("path_id"), ((n + 1) % 2 + 1).alias("path_step"), F.when(n <= 4, 2).alias("path_length"),
        kind, F.when(F.col("l_tax") == 0.08, " ").otherwise("seen").alias("evidence_text"),
    )
    sources = li.where("l_quantity > 25").select(node_id("q", "l_orderkey").alias("q"), kind)
    return [questions, manifest, evidence, answers, sources, spark.createDataFrame([(0, "part 1"), (0, "Part_2")], "g int, item string")]


_SCORES = """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_custkey % 11 = 0 AS u, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 WHEN o_custkey % 11 <> 0 AND o_custkey % 3 > 0 THEN 1 ELSE 0 END AS hops FROM orders),
e AS (SELECT l_orderkey AS k, l_linenumber AS ln, 'part ' || l_partkey % 7 AS s, 'supplier ' || l_suppkey % 5 AS t, CASE l_returnflag WHEN 'R' THEN 'treats' WHEN 'A' THEN 'prevents' ELSE 'associated with' END AS r,
  CASE WHEN l_linenumber <= 4 THEN 'p' || (l_linenumber + 1) // 2 ELSE 'e' || l_linenumber END AS p, (l_linenumber + 1) % 2 + 1 AS step, CASE WHEN l_linenumber <= 4 THEN 2 ELSE 1 END AS len, l_linestatus = 'O' AS isdef, l_tax <> 0.08 AS told FROM lineitem WHERE l_partkey % 5 <> 0),
g AS (SELECT k, count(*) AS n, max(len) AS longest, bool_or(isdef AND told) AS def, bool_or(isdef) AS hasdef, bool_or(NOT isdef) AS hasgraph, bool_or(ln <= 2) AS idhit, list(s) || list(t) AS names, list(r) AS rels FROM e GROUP BY k),
p AS (SELECT k, max(least(steps, len)) AS most FROM (SELECT k, p, count(DISTINCT step) AS steps, max(len) AS len FROM e GROUP BY k, p) GROUP BY k),
s AS (SELECT l_orderkey AS k, bool_or(l_linestatus = 'O') AS hasdef, bool_or(l_linestatus <> 'O') AS hasgraph FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey),
x AS (SELECT o.*, o.k % 9 <> 0 AS known, g.n, g.longest, coalesce(g.def, false) AS def, CASE WHEN c % 6 = 0 THEN coalesce(g.idhit, false) ELSE true END AS idhit,
  CASE WHEN hops = 0 THEN g.n IS NULL WHEN hops = 1 THEN g.n IS NOT NULL ELSE coalesce(p.most >= hops, false) END AS pc,
  CASE WHEN c % 2 = 0 THEN coalesce(g.hasdef AND g.hasgraph, false) WHEN c % 5 = 0 THEN coalesce(g.hasgraph, false) ELSE true END AS rk, CASE WHEN c % 2 = 0 THEN coalesce(s.hasdef AND s.hasgraph, false) WHEN c % 5 = 0 THEN coalesce(s.hasgraph, false) ELSE true END AS sk,
  s.k IS NOT NULL AS cited, CASE WHEN o.k % 4 = 0 OR o.k % 14 = 0 THEN 0 WHEN o.k % 3 = 0 THEN 2 ELSE 1 END AS fh,
  CASE WHEN coalesce(list_contains(names, 'part ' || c % 7) OR c % 7 IN (1, 2) AND (list_contains(names, 'part 1') OR list_contains(names, 'part 2')), false) THEN 1 ELSE 0 END + CASE WHEN coalesce(list_contains(names, 'supplier ' || c % 5), false) THEN 1 ELSE 0 END AS eh,
  CASE WHEN c % 3 > 0 AND coalesce(list_contains(rels, 'treats'), false) THEN 1 ELSE 0 END + CASE WHEN c % 3 = 2 AND coalesce(list_contains(rels, 'associated with'), false) THEN 1 ELSE 0 END AS rh, c % 3 AS rt,
  CASE WHEN o.k % 10 = 0 THEN g.n IS NULL WHEN o.k % 4 <> 0 THEN o.k % 7 = 0 ELSE o.k % 6 = 0 END AS ab FROM o LEFT JOIN g ON g.k = o.k LEFT JOIN p ON p.k = o.k LEFT JOIN s ON s.k = o.k),
y AS (SELECT *, CASE WHEN u THEN n IS NULL ELSE n IS NOT NULL AND eh = 2 AND rh = rt AND idhit AND pc AND rk END AS rs, CASE WHEN NOT u AND NOT ab THEN cited AND sk ELSE ab END AS cs FROM x),
z AS (SELECT *, fh > 0 AND NOT ab AND NOT rs AS ua FROM y),
q AS (SELECT *, CASE WHEN k % 10 = 0 THEN false WHEN u THEN ab ELSE NOT ab AND fh = 2 AND cs AND NOT ua END AS good FROM z)
SELECT 'q' || k AS question_id, 'order ' || k AS question, st AS question_type, 'dev' AS split, CASE WHEN NOT known OR k % 8 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN NOT known THEN 'missing' WHEN k % 10 = 0 THEN 'skipped' ELSE 'ok' END AS answer_status,
  CASE WHEN known THEN k % 5 ELSE 0 END AS retrieved_count, 0 AS source_count, hops AS hop_count, CASE WHEN known THEN coalesce(longest, 0) ELSE 0 END AS max_retrieved_path_length, known AND pc AS path_complete, known AND def AS definition_source_hit,
  CASE WHEN c % 2 = 0 THEN 'definition;graph' WHEN c % 5 = 0 THEN 'graph' ELSE '' END AS required_evidence_kinds, known AND rk AS retrieved_required_evidence_kinds, known AND sk AS source_required_evidence_kinds,
  CASE WHEN known THEN fh ELSE 0 END AS expected_fact_hits, 2 AS expected_fact_total, CASE WHEN known THEN fh / 2 ELSE 0.0 END AS fact_coverage, CASE WHEN known THEN eh ELSE 0 END AS entity_hits, CASE WHEN known THEN 2 ELSE 3 END AS entity_total, CASE WHEN known THEN eh / 2 ELSE 0.0 END AS entity_coverage,
  CASE WHEN known THEN rh ELSE 0 END AS relationship_hits, rt AS relationship_total, CASE WHEN rt = 0 THEN 1.0 WHEN known THEN rh / rt ELSE 0.0 END AS relationship_coverage, known AND idhit AS expected_evidence_hit, known AND rs AS retrieval_success, known AND cs AS citation_supported, known AND ab AS abstained,
  u AS expected_abstention, known AND ab = u AS abstention_correct, known AND ua AS unsupported_answer, 'disabled' AS llm_judge_status, '' AS llm_judge_supported, '' AS llm_judge_score, '' AS llm_judge_notes, known AND good AS answer_success, CASE WHEN NOT known THEN 'missing manifest row' WHEN k % 8 = 0 THEN 'late' ELSE '' END AS error FROM q"""


@query("question_scores", _SCORES)
def question_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.question_scores(*_run(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of customers, some of them unknown; line items tell how the extraction went."""
    o = table(spark, sf_dir, "orders")
    chunks = o.select(node_id("c", "o_orderkey").alias("chunk_id"), node_id("d", "o_custkey").alias("document_id"), node_id("PMC", "o_custkey").alias("pmcid"))
    docs = table(spark, sf_dir, "customer").where("c_nationkey <> 3").select(node_id("d", "c_custkey").alias("document_id"))
    out = table(spark, sf_dir, "lineitem").groupBy(node_id("c", "l_orderkey").alias("chunk_id")).agg(
        F.count("*").alias("entity_count"), F.count_if(F.col("l_returnflag") == "R").alias("relationship_count"), F.count_if(F.col("l_returnflag") == "A").alias("rejected_candidate_count"), F.max("l_linenumber").alias("model_call_count"), F.when(F.max("l_quantity") > 49, "timed out").alias("error")
    )
    return evaluate.chunk_results(chunks, docs, out)


_RESULTS = """WITH x AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'A') AS a, max(l_linenumber) AS m, max(l_quantity) > 49 AS bad FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o.*, x.*, c_custkey IS NULL AS lost FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) ON c_custkey = o_custkey LEFT JOIN x ON k = o_orderkey),
res AS (SELECT *, CASE WHEN lost THEN 'error' WHEN k IS NULL THEN 'pending' WHEN bad THEN 'error' ELSE 'ok' END AS status FROM j)
"""


@query(
    "chunk_results",
    _RESULTS + "SELECT 'c' || o_orderkey AS chunk_id, CASE WHEN NOT lost THEN 'd' || o_custkey END AS document_id, CASE WHEN NOT lost THEN 'PMC' || o_custkey END AS pmcid, status, CASE WHEN status = 'ok' THEN n END AS entity_count, CASE WHEN status = 'ok' THEN r END AS relationship_count, "
    "CASE WHEN status = 'ok' THEN a END AS rejected_candidate_count, CAST(CASE WHEN status = 'ok' THEN m END AS BIGINT) AS model_call_count, CASE WHEN lost THEN 'Chunk references unknown document_id: d' || o_custkey WHEN bad THEN 'timed out' ELSE '' END AS error FROM res",
)
def chunk_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)


@query("result_counts", _RESULTS + "SELECT count(*) AS chunk_count, count(*) FILTER (WHERE status = 'ok') AS success_count, count(*) FILTER (WHERE status = 'error') AS error_count FROM res")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.result_counts(_results(spark, sf_dir))


@query(
    "evidence_records",
    """WITH e AS (SELECT l_orderkey, l_linenumber, 'rel:' || l_orderkey || '-' || l_linenumber AS id, l_linenumber % 2 = 0 AS named, 'part ' || l_partkey AS s, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'supplier ' || l_suppkey END AS t, l_returnflag AS type,
  CASE WHEN l_linenumber % 3 = 0 THEN 'first' WHEN l_linenumber % 3 = 1 THEN 'third' ELSE '' END AS evidence, CASE WHEN l_tax <> 0.08 THEN round(1 - l_discount, 2) END AS confidence, 'c' || l_linenumber AS chunk_id FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN named THEN id ELSE 'evidence:' || sha1(s || '|' || type || '|' || t || '|' || chunk_id) END AS id, s AS source_name, type AS relationship_type, t AS target_name, evidence AS evidence_text, confidence, chunk_id, 1 AS path_step, 0.0 AS match_score, 'graph' AS evidence_kind FROM e""",
)
def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    props = {"id": F.when(n % 2 == 0, F.concat_ws("-", node_id("rel:", "l_orderkey"), "l_linenumber")).otherwise(""), "evidence": F.when(n % 3 == 0, "first"), "evidenceText": F.when(n % 3 < 2, "third"), "confidence": F.when(F.col("l_tax") == 0.08, "high").otherwise(F.round(1 - F.col("l_discount"), 2).cast("string")), "chunk_id": node_id("c", "l_linenumber")}
    e = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.lit("none").alias("id"), F.col("l_returnflag").alias("type"), node_id("part ", "l_partkey").alias("src_name"), F.when(F.col("l_suppkey") % 3 != 0, node_id("supplier ", "l_suppkey")).alias("dst_name"),
        F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v)]).alias("props"),
    )
    rows = retrieve.edge_records(e, keep=["l_orderkey", "l_linenumber"])
    return retrieve.evidence_rows(rows).select("l_orderkey", "l_linenumber", "id", "source_name", "relationship_type", "target_name", "evidence_text", "confidence", "chunk_id", "path_step", "match_score", "evidence_kind")
