"""Queries over evaluation, review, jobs, runs, inputs and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as T
from ..operators import answer as A
from ..operators import artifacts, evaluate, review
from ..sources import readers, sinks, versions
from ..streaming import jobs as J
from ..streaming import progress
from .tables import GRAPH_SQL, edges, node_id, nodes, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic labels against a word rule, over the labelled documents; with the language as bucket."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    gold = docs.where("toxic = 1").select("doc_id", "lang")
    said = docs.where(T.has_any(F.lower("text"), ["idiot", "moron"])).select("doc_id", "lang")
    return evaluate.outcomes(gold, said, ["doc_id", "lang"])


_PRF = """WITH d AS (SELECT doc_id, lang, text, toxic FROM documents JOIN labels USING (doc_id)),
o AS (SELECT doc_id, lang, CASE WHEN toxic = 1 AND hit THEN 'tp' WHEN hit THEN 'fp' ELSE 'fn' END AS outcome FROM (SELECT *, contains(lower(text), 'idiot') OR contains(lower(text), 'moron') AS hit FROM d) WHERE toxic = 1 OR hit),
c AS (SELECT {0} count(*) FILTER (WHERE outcome = 'tp') AS true_positive, count(*) FILTER (WHERE outcome = 'fp') AS false_positive, count(*) FILTER (WHERE outcome = 'fn') AS false_negative FROM o {1}),
r AS (SELECT *, CASE WHEN true_positive + false_positive > 0 THEN true_positive / (true_positive + false_positive) ELSE 0.0 END AS p, CASE WHEN true_positive + false_negative > 0 THEN true_positive / (true_positive + false_negative) ELSE 0.0 END AS q FROM c)
SELECT {0} true_positive, false_positive, false_negative, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS f1 FROM r"""


@query("prf_metrics", _PRF.format("", ""))
def prf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_matched(spark, sf_dir))


@query("prf_by_bucket", _PRF.format("lang,", "GROUP BY lang"))
def prf_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_matched(spark, sf_dir), ["lang"])


_SETS = """WITH d AS (SELECT doc_id, lang, source, text, toxic, quality FROM documents JOIN labels USING (doc_id)),
h AS (SELECT *, contains(lower(text), 'idiot') OR contains(lower(text), 'moron') AS hit, contains(text, '###') AS junk FROM d),
o AS (SELECT 'entities' AS scope, lang AS label, CASE WHEN toxic = 1 AND hit THEN 'tp' WHEN hit THEN 'fp' ELSE 'fn' END AS outcome FROM h WHERE toxic = 1 OR hit
  UNION ALL SELECT 'relationships', lang, CASE WHEN quality = 0 AND junk THEN 'tp' WHEN junk THEN 'fp' ELSE 'fn' END FROM h WHERE quality = 0 OR junk),
c AS (SELECT 'overall' AS scope, '' AS label, outcome FROM o UNION ALL SELECT scope, '', outcome FROM o UNION ALL SELECT CASE scope WHEN 'entities' THEN 'entity_type' ELSE 'relationship_type' END, label, outcome FROM o),
k AS (SELECT scope, label, count(*) FILTER (WHERE outcome = 'tp') AS true_positive, count(*) FILTER (WHERE outcome = 'fp') AS false_positive, count(*) FILTER (WHERE outcome = 'fn') AS false_negative FROM c GROUP BY scope, label),
r AS (SELECT *, CASE WHEN true_positive + false_positive > 0 THEN true_positive / (true_positive + false_positive) ELSE 0.0 END AS p, CASE WHEN true_positive + false_negative > 0 THEN true_positive / (true_positive + false_negative) ELSE 0.0 END AS q FROM k)
SELECT scope, label, true_positive, false_positive, false_negative, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS f1 FROM r"""


@query("prf_overall", _SETS)
def prf_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").join(table(spark, sf_dir, "labels"), "doc_id")
    junk = evaluate.outcomes(docs.where("quality = 0"), docs.where(F.contains("text", F.lit("###"))), ["doc_id", "lang"])
    return evaluate.metrics_table(_matched(spark, sf_dir), junk, "lang", "lang")


@query("macro_f1", "WITH x AS (" + _PRF.format("lang,", "GROUP BY lang") + ") SELECT round(avg(f1), 6) AS macro_f1 FROM x")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.macro_f1(_matched(spark, sf_dir), "lang")


def _qa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    k = F.col("doc_id")
    return evaluate.score_questions(
        d.select(
            "doc_id", F.when(F.col("lang") == "de", "").otherwise(F.col("lang")).alias("label"), F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"), F.when(k % 11 == 0, "skipped").otherwise("ok").alias("answer_status"), (k % 4).alias("retrieved_count"), (k % 5).alias("source_count"),
            ((k % 3) / 2).alias("fact_coverage"), ((k % 2) / 1).alias("entity_coverage"), F.when(k % 7 == 0, 0.5).otherwise(1.0).alias("relationship_coverage"), (k % 13 != 0).alias("evidence_hit"), (k % 6 != 0).alias("path_complete"), (k % 8 != 0).alias("retrieved_kinds"), (k % 9 != 0).alias("source_kinds"),
            (F.col("toxic") == 1).alias("abstained"), (k % 10 == 0).alias("unanswerable"), F.when(k % 14 != 0, "said").otherwise("").alias("answer"), (k % 3).alias("hops"), F.when(k % 3 == 0, "definition;graph").when(k % 3 == 1, "graph").otherwise("").alias("required_kinds"),
        )
    )


_QA = """WITH d AS (SELECT doc_id AS k, CASE lang WHEN 'de' THEN 'unspecified' ELSE lang END AS label, quality = 1 AS ok, toxic = 1 AS ab FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, CASE WHEN k % 10 = 0 THEN k % 4 = 0 ELSE k % 4 > 0 AND k % 2 = 1 AND k % 7 <> 0 AND k % 13 <> 0 AND k % 6 <> 0 AND k % 8 <> 0 END AS rs, CASE WHEN k % 10 <> 0 AND NOT ab THEN k % 5 > 0 AND k % 9 <> 0 ELSE ab END AS cs FROM d),
u AS (SELECT *, k % 14 <> 0 AND NOT ab AND NOT rs AS ua FROM r),
s AS (SELECT *, CASE WHEN k % 11 = 0 THEN false WHEN k % 10 = 0 THEN ab ELSE NOT ab AND k % 3 = 2 AND cs AND NOT ua END AS ans FROM u)
SELECT {0} count(*) AS question_count, count(*) FILTER (WHERE ok) AS success_count, count(*) FILTER (WHERE NOT ok) AS error_count, round(count(*) FILTER (WHERE rs) / count(*), 6) AS retrieval_recall, round(count(*) FILTER (WHERE ans) / count(*), 6) AS answer_accuracy,
  round(count(*) FILTER (WHERE ab = (k % 10 = 0)) / count(*), 6) AS abstention_accuracy, round(count(*) FILTER (WHERE cs) / count(*), 6) AS citation_support_rate, round(count(*) FILTER (WHERE ua) / count(*), 6) AS unsupported_answer_rate,
  round(avg((k % 3) / 2), 6) AS mean_fact_coverage, round(avg(k % 2), 6) AS mean_entity_coverage, round(avg(CASE WHEN k % 7 = 0 THEN 0.5 ELSE 1.0 END), 6) AS mean_relationship_coverage, round(count(*) FILTER (WHERE k % 6 <> 0) / count(*), 6) AS path_complete_rate,
  round(count(*) FILTER (WHERE k % 8 <> 0) / count(*), 6) AS required_evidence_kind_recall, round(count(*) FILTER (WHERE k % 9 <> 0) / count(*), 6) AS required_evidence_kind_citation_rate,
  coalesce(round(count(*) FILTER (WHERE rs AND k % 3 > 1) / nullif(count(*) FILTER (WHERE k % 3 > 1), 0), 6), 0.0) AS multi_hop_retrieval_recall, coalesce(round(count(*) FILTER (WHERE rs AND k % 3 = 0) / nullif(count(*) FILTER (WHERE k % 3 = 0), 0), 6), 0.0) AS definition_required_retrieval_recall,
  coalesce(round(count(*) FILTER (WHERE cs AND k % 3 = 0) / nullif(count(*) FILTER (WHERE k % 3 = 0), 0), 6), 0.0) AS mixed_evidence_citation_rate FROM s {1}"""


@query("qa_metrics", _QA.format("", ""))
def qa_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.qa_metrics(_qa_rows(spark, sf_dir))


@query("qa_by_bucket", _QA.format("label,", "GROUP BY label"))
def qa_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.qa_metrics(_qa_rows(spark, sf_dir), "label")


@query(
    "path_completeness",
    "WITH p AS (SELECT l_orderkey AS q, l_partkey % 3 AS p, count(DISTINCT l_linenumber % 2) AS steps, max(l_linenumber % 3) AS length FROM lineitem GROUP BY l_orderkey, l_partkey % 3), m AS (SELECT q, max(least(steps, length)) AS most, count(*) AS n FROM p GROUP BY q) "
    "SELECT o_orderkey AS q, CASE WHEN o_orderkey % 3 = 0 THEN n IS NULL WHEN o_orderkey % 3 = 1 THEN n IS NOT NULL ELSE coalesce(most >= 2, false) END AS path_complete FROM orders LEFT JOIN m ON q = o_orderkey",
)
def path_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q"), F.lit("x").alias("id"), (F.col("l_partkey") % 3).cast("string").alias("path_id"), (F.col("l_linenumber") % 2).alias("path_step"), (F.col("l_linenumber") % 3).alias("path_length"))
    return evaluate.path_complete(ev, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), (F.col("o_orderkey") % 3).alias("hops")))


@query(
    "alias_coverage",
    "WITH a(g, v) AS (VALUES (0, 'red widget'), (0, 'blue bolt'), (1, 'small ring'), (1, 'large gear')), e AS (SELECT p_partkey // 20 AS q, p_name AS v FROM part), o AS (SELECT DISTINCT (p_partkey // 20 + 1) AS q, p_name AS v FROM part), "
    "w AS (SELECT q, v, v AS x FROM e UNION SELECT e.q, e.v, b.v FROM e JOIN a ON a.v = e.v JOIN a b ON a.g = b.g), ow AS (SELECT q, v AS x FROM o UNION SELECT o.q, b.v FROM o JOIN a ON a.v = o.v JOIN a b ON a.g = b.g), "
    "h AS (SELECT DISTINCT w.q, w.v FROM w JOIN ow ON w.q = ow.q AND w.x = ow.x) SELECT e.q, CAST(count(h.v) AS BIGINT) AS hits, count(*) AS total, round(count(h.v) / count(*), 6) AS coverage FROM e LEFT JOIN h ON e.q = h.q AND e.v = h.v GROUP BY e.q",
)
def alias_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.expr("p_partkey div 20").alias("q"), F.col("p_name").alias("item"))
    groups = spark.createDataFrame([(0, "red widget"), (0, "Blue_bolt"), (1, "small ring"), (1, "large  gear")], "g int, item string")
    return evaluate.coverage(p, p.withColumn("q", F.col("q") + 1), groups)


@query("selected_chunks", "SELECT o_orderkey AS chunk_index, 'c' || o_custkey AS chunk_id FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def selected_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_index"), node_id("c", "o_custkey").alias("chunk_id"), F.col("o_orderdate").alias("pmcid"), F.when(F.col("o_orderstatus") == "P", " No ").otherwise("yes").alias("included_in_gold_annotation"))
    return evaluate.selected_chunks(o, 100).select("chunk_index", "chunk_id")


@query("judge_report", "SELECT count(*) AS judged_count, round(count(*) FILTER (WHERE value > 10) / count(*), 6) AS supported_rate, round(avg(round(value)), 6) AS mean_score FROM events WHERE event_type <> 'error'")
def judge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("value") > 10).alias("supported"), F.round("value").alias("score"))
    return evaluate.judge_report(e)


def _sheets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as chunks, customers as entities, events as relationships; with faults of every kind."""
    o = table(spark, sf_dir, "orders")
    chunks = o.select(
        F.col("o_orderkey").alias("row_number"), F.when(F.col("o_custkey") % 50 == 0, " ").otherwise(node_id("c", "o_custkey")).alias("chunk_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("chunk_text"), F.lit("0").alias("start_char"),
        F.when(F.col("o_orderstatus") == "P", "draft").otherwise("accepted").alias("annotation_status"),
    )
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Drug").when(F.col("c_mktsegment") == "MACHINERY", "Machine").otherwise("Condition")
    state = lambda k: F.when(F.col(k) % 3 == 0, "accepted").when(F.col(k) % 3 == 1, "rejected").otherwise("needs_review")
    entities = c.select(
        F.col("c_custkey").alias("row_number"), F.concat(F.lit("c"), F.col("c_custkey") % 1200).alias("chunk_id"), node_id("e", "c_custkey").alias("entity_id"), kind.alias("entity_type"), F.when(F.col("c_custkey") % 97 == 0, "").otherwise(F.col("c_name")).alias("entity_text"),
        F.lit("").alias("normalized_name"), F.when(F.col("c_custkey") % 2 == 0, "5-low").otherwise("absent").alias("evidence_text"), F.lit("0").alias("evidence_start_char"), F.lit("x").alias("evidence_end_char"), state("c_nationkey").alias("annotation_status"),
    )
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    rel = F.when(F.col("event_type") == "click", "TREATS").when(F.col("event_type") == "error", "BROKEN").otherwise("ASSOCIATED_WITH")
    relations = e.select(
        k.alias("row_number"), F.concat(F.lit("c"), k % 1300).alias("chunk_id"), rel.alias("relationship_type"), F.when(k % 2 == 0, "O").otherwise("nothing").alias("evidence_text"), F.lit("1").alias("evidence_start_char"), F.lit("2").alias("evidence_end_char"),
        F.when(k % 4 == 3, "draft").otherwise("accepted").alias("annotation_status"), F.when(k % 5 == 4, "exclude").otherwise("include").alias("annotation_decision"), F.when(k % 6 == 5, "no").otherwise("yes").alias("direction_verified"), F.when(k % 7 == 6, "yes").otherwise("no").alias("negated"),
        F.when(k % 8 == 7, "unclear").otherwise("no").alias("speculative"), F.when(k % 9 == 8, "weak_implication").otherwise("explicit").alias("explicit_or_implied"), F.concat(F.lit("e"), k % 1300).alias("source_entity_id"), F.lit("").alias("source_entity_type"), F.lit("").alias("source_entity_text"), F.lit("").alias("source_normalized_name"),
        F.lit("").alias("target_entity_id"), F.lit("DRUG").alias("target_entity_type"), F.concat(F.lit("customer#"), F.lpad((k % 1300).cast("string"), 9, "0")).alias("target_entity_text"), F.lit("").alias("target_normalized_name"),
    )
    return chunks, entities, relations


_SHEETS = """WITH ch AS (SELECT o_orderkey AS r, CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'c' || o_custkey END AS id, o_orderpriority || ' ' || o_orderstatus AS t, o_orderstatus = 'P' AS open FROM orders),
k AS (SELECT id, min(r) AS f, arg_max(t, r) AS t FROM ch WHERE id <> '' GROUP BY id),
en AS (SELECT c_custkey AS r, 'c' || (c_custkey % 1200) AS id, 'e' || c_custkey AS eid, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Drug' WHEN 'MACHINERY' THEN 'Machine' ELSE 'Condition' END AS kind, CASE WHEN c_custkey % 97 = 0 THEN '' ELSE c_name END AS txt, CASE WHEN c_custkey % 2 = 0 THEN '5-low' ELSE 'absent' END AS ev, c_nationkey % 3 AS s FROM customer),
re AS (SELECT event_id AS r, 'c' || (event_id % 1300) AS id, event_type, CASE WHEN event_id % 2 = 0 THEN 'o' ELSE 'nothing' END AS ev, event_id % 4 = 3 AS open, event_id % 5 <> 4 AS inc, 'e' || (event_id % 1300) AS src, 'customer#' || lpad(CAST(event_id % 1300 AS VARCHAR), 9, '0') AS dst FROM events),
ok AS (SELECT re.*, k.t FROM re LEFT JOIN k ON k.id = re.id WHERE NOT open AND inc),
acc AS (SELECT * FROM en WHERE s = 0)
"""


@query(
    "validation_issues",
    _SHEETS
    + """, i AS (
SELECT 'chunks' AS sheet, 'Chunk row is missing chunk_id.' AS message FROM ch WHERE id = ''
UNION ALL SELECT 'chunks', 'Duplicate chunk_id in chunks sheet.' FROM ch JOIN k ON ch.id = k.id WHERE r > f
UNION ALL SELECT 'chunks', 'Chunk is still unresolved; mark reviewed or accepted before gold export.' FROM ch WHERE id <> '' AND open
UNION ALL SELECT 'gold_entities', 'Entity row is still unresolved.' FROM en WHERE s = 2
UNION ALL SELECT 'gold_entities', 'Invalid entity type' FROM acc WHERE kind = 'Machine'
UNION ALL SELECT 'gold_entities', 'Accepted entity is missing entity_text.' FROM acc WHERE txt = ''
UNION ALL SELECT 'gold_entities', 'Accepted entity references an unknown chunk.' FROM acc WHERE id NOT IN (SELECT id FROM k)
UNION ALL SELECT 'gold_entities', 'Accepted entity evidence_text or offsets do not match the chunk text.' FROM acc JOIN k ON acc.id = k.id WHERE NOT contains(lower(k.t), ev)
UNION ALL SELECT 'gold_relationships', 'Relationship row is still unresolved.' FROM re WHERE open
UNION ALL SELECT 'gold_relationships', 'Invalid relationship type' FROM ok WHERE event_type = 'error'
UNION ALL SELECT 'gold_relationships', 'Accepted relationship references an unknown chunk.' FROM ok WHERE t IS NULL
UNION ALL SELECT 'gold_relationships', 'Accepted relationship evidence_text or offsets do not match the chunk text.' FROM ok WHERE t IS NOT NULL AND NOT contains(lower(t), ev) AND lower(substring(t, 2, 1)) <> ev
UNION ALL SELECT 'gold_relationships', 'Accepted relationship must have direction_verified=yes.' FROM ok WHERE r % 6 = 5
UNION ALL SELECT 'gold_relationships', 'Accepted relationship must have negated=no.' FROM ok WHERE r % 7 = 6
UNION ALL SELECT 'gold_relationships', 'Accepted relationship must have speculative=no.' FROM ok WHERE r % 8 = 7
UNION ALL SELECT 'gold_relationships', 'Weakly implied relationships are not exported to the core gold set.' FROM ok WHERE r % 9 = 8
UNION ALL SELECT 'gold_relationships', 'Accepted relationship source endpoint does not map to an accepted entity in the same chunk.' FROM ok WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.id = ok.id AND acc.eid = ok.src)
UNION ALL SELECT 'gold_relationships', 'Accepted relationship target endpoint does not map to an accepted entity in the same chunk.' FROM ok WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.id = ok.id AND lower(acc.kind) = 'drug' AND txt <> '' AND lower(acc.txt) = ok.dst))
SELECT sheet, message, count(*) AS n FROM i GROUP BY sheet, message""",
)
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.issues(*_sheets(spark, sf_dir)).groupBy("sheet", "message").agg(F.count("*").alias("n"))


@query(
    "validation_summary",
    _SHEETS
    + """SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(*) FROM ch) AS chunk_count, (SELECT count(*) FROM en) AS entity_rows, (SELECT count(*) FROM acc) AS accepted_entities, (SELECT count(*) FROM en WHERE s = 1) AS rejected_entities, (SELECT count(*) FROM en WHERE s = 2) AS unresolved_entities,
(SELECT count(*) FROM re) AS relationship_rows, (SELECT count(*) FROM ok) AS accepted_relationships, (SELECT count(*) FROM re WHERE NOT inc) AS rejected_relationships, (SELECT count(*) FROM re WHERE open) AS unresolved_relationships""",
)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.summary(table(spark, sf_dir, "documents"), *_sheets(spark, sf_dir))


@query("gold_export", _SHEETS + "SELECT r AS row_number, id AS chunk_id, kind AS entity_type FROM acc")
def gold_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, entities, relations = _sheets(spark, sf_dir)
    return review.gold(entities, relations)[0].select("row_number", "chunk_id", "entity_type")


@query("coverage_exact", "SELECT o_orderkey AS k, 'missing' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'extra' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def coverage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.coverage(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query(
    "reviewed_rows",
    "WITH r AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS p, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey) SELECT c_custkey, CASE WHEN s IN ('F', 'O') THEN p ELSE c_mktsegment END AS segment, CASE WHEN s IS NULL THEN 'draft' WHEN s IN ('F', 'O') THEN 'accepted' ELSE 'rejected' END AS annotation_status FROM customer LEFT JOIN r ON c_custkey = id",
)
def reviewed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit("draft").alias("annotation_status"))
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("segment"), F.max_by("o_orderstatus", "o_orderkey").alias("decision")).withColumn("reason", F.lit("seen"))
    return review.reviewed(rows, r, "c_custkey", ["segment"], ["F", "O"]).select("c_custkey", "segment", "annotation_status")


@query("last_by_id", "SELECT o_custkey AS id, arg_max(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS place FROM orders GROUP BY o_custkey")
def last_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return evaluate.last_by_id(o, "id", "seq").select(F.col("id").cast("long").alias("id"), "status", "place")


@query("finetune_records", """SELECT u.conv_id, u.turn, '{"messages":[{"role":"user","content":' || to_json(u.text) || '},{"role":"assistant","content":' || to_json(a.text) || '}]}' AS line FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def finetune_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.chat_lines(readers.exchanges(table(spark, sf_dir, "conversations")))


@query("reasoning_paths", "SELECT conv_id, role AS path_id, max(turn) AS length, string_agg(role || ' -> ' || turn, ' | ' ORDER BY turn) AS steps FROM conversations GROUP BY conv_id, role")
def reasoning_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("path_id"), F.col("turn").alias("path_length"), F.col("turn").alias("path_step"), F.col("turn").alias("pos"), F.col("role").alias("source"), F.col("turn").cast("string").alias("target"))
    return A.grouped_steps(c, "conv_id").withColumn("steps", F.array_join("steps", " | "))


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("completed")
    j = o.select(F.col("o_orderkey").alias("job_id"), state.alias("status"), F.col("o_orderdate").alias("submitted_at"), F.when(F.col("o_orderkey") % 5 == 0, "full disk").otherwise("").alias("error"))
    li = table(spark, sf_dir, "lineitem")
    d = li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "A", "completed").when(F.col("l_returnflag") == "R", "failed").otherwise("running").alias("status"), F.lit("").alias("error"))
    return j, d


@query("job_progress", "SELECT o_orderkey AS job_id, count(l_orderkey) AS n_documents, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS n_done, CASE WHEN count(l_orderkey) > 0 THEN round(count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) / count(l_orderkey), 6) ELSE 0.0 END AS progress FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.progress(*_jobs(spark, sf_dir)).select("job_id", "n_documents", "n_done", "progress")


@query("next_jobs", "SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 3")
def next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.next_job(_jobs(spark, sf_dir)[0], 3).select("job_id")


@query("moved_jobs", "SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'cancelled' WHEN 'P' THEN 'running' ELSE 'completed' END AS status FROM orders")
def moved_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j, _ = _jobs(spark, sf_dir)
    return J.moved(j, j.select("job_id", F.lit("cancelled").alias("to"))).select("job_id", "status")


@query("recover_jobs", f"SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'full disk' WHEN o_orderstatus = 'P' THEN '{J.INTERRUPTED}' ELSE '' END AS error FROM orders")
def recover_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recovered(*_jobs(spark, sf_dir))[0].select("job_id", "status", "error")


@query("recover_documents", "SELECT CASE WHEN l_returnflag = 'A' THEN 'completed' WHEN l_returnflag = 'R' OR o_orderstatus = 'P' THEN 'failed' ELSE 'running' END AS status, count(*) AS n FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def recover_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recovered(*_jobs(spark, sf_dir))[1].groupBy("status").agg(F.count("*").alias("n"))


@query("job_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.counts(spark, sf_dir, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", "events.parquet", "event_type", f"job_stream_{uuid.uuid4().hex}")


_EVENT_SQL = "e AS (SELECT user_id AS job, coalesce(props ->> '$.k', '') AS doc, ts, event_id, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'skipped' END AS told FROM events)"


@query(
    "document_progress",
    f"""WITH {_EVENT_SQL}, s AS (SELECT job, doc, count(*) AS n, arg_max(told, (ts, event_id)) FILTER (WHERE told IS NOT NULL) AS status, min(ts) FILTER (WHERE told = 'running') AS a, max(ts) FILTER (WHERE told IN ('completed', 'skipped')) AS b FROM e GROUP BY job, doc)
SELECT CAST(job AS VARCHAR) AS job_id, count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS n_events, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  CAST(sum(epoch_us(a)) AS HUGEINT)::VARCHAR AS started, CAST(sum(epoch_us(b)) AS HUGEINT)::VARCHAR AS finished FROM s GROUP BY job""",
)
def document_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of documents (a property of the events) within jobs (their users), from a stream of the events."""
    raw = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    event = F.when(F.col("event_type").isin("click", "view"), "article_started").when(F.col("event_type") == "purchase", "article_finished").when(F.col("event_type") == "signup", "article_skipped").otherwise(F.col("event_type"))
    told = raw.select(F.col("user_id").alias("job_id"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("document"), event.alias("event"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    top = f"{shared.folder(spark)}/progress_{uuid.uuid4().hex}"
    progress.follow(spark, told, f"{top}/states", f"{top}/checkpoint")
    state = progress.states(spark, f"{top}/states")
    total = lambda c: F.sum(F.unix_micros(c).cast("decimal(38,0)")).cast("string")
    return progress.job_counts(state, total("started_at").alias("started"), total("finished_at").alias("finished"))


@query(
    "rewritten_graph",
    f"""WITH {GRAPH_SQL}, n AS (SELECT id, label, name FROM nodes WHERE NOT (label = 'Drug' AND name LIKE 'red%')),
e AS (SELECT id, type, src, dst, confidence FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
sn AS (SELECT 'condition:' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'renamed ' || s_suppkey END AS name FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT 'sample:' || r_regionkey, r_name FROM region),
se AS (SELECT 'sample-edge:' || r_regionkey AS id, 'ASSOCIATED_WITH' AS type, 'sample:' || r_regionkey AS src, 'riskfactor:' || r_regionkey AS dst, 0.5 AS confidence FROM region),
n2 AS (SELECT coalesce(n.id, sn.id) AS id, n.label, coalesce(sn.name, n.name) AS name FROM n FULL JOIN sn ON n.id = sn.id), e2 AS (SELECT * FROM e UNION ALL SELECT * FROM se)
SELECT 'node' AS kind, label AS type, count(*) AS n, CAST(sum(length(id)) + coalesce(sum(length(name)), 0) AS BIGINT) AS chars FROM n2 GROUP BY label UNION ALL SELECT 'edge', type, count(*), CAST(sum(length(id) + length(src) + length(dst)) AS BIGINT) FROM e2 GROUP BY type""",
)
def rewritten_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph in versioned folders after a tagged delete and a seed, each called twice."""
    top = f"{shared.folder(spark)}/graph_{uuid.uuid4().hex}"
    n, e = f"{top}/nodes", f"{top}/edges"
    versions.rewrite(spark, n, "load", lambda: nodes(spark, sf_dir))
    versions.rewrite(spark, e, "load", lambda: edges(spark, sf_dir).select("id", "type", "src", "dst", "confidence"))
    s, r = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0"), table(spark, sf_dir, "region")
    new = s.select(node_id("condition:", "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, node_id("renamed ", "s_suppkey")).alias("name")).unionByName(r.select(node_id("sample:", "r_regionkey").alias("id"), F.col("r_name").alias("name")))
    links = r.select(node_id("sample-edge:", "r_regionkey").alias("id"), F.lit("ASSOCIATED_WITH").alias("type"), node_id("sample:", "r_regionkey").alias("src"), node_id("riskfactor:", "r_regionkey").alias("dst"), F.lit(0.5).alias("confidence"))
    for _ in range(2):  # the second time each change is there
        versions.delete_nodes(spark, n, e, (F.col("label") == "Drug") & F.col("name").startswith("red"), "without_red")
        versions.seed(spark, n, e, new, links, "sample")
    a, b = versions.current(spark, n), versions.current(spark, e)
    chars = lambda *cs: sum((F.coalesce(F.length(c), F.lit(0)) for c in cs), F.lit(0)).cast("long")
    tally = lambda df, kind, by, *cs: df.groupBy(F.col(by).alias("type")).agg(F.count("*").alias("n"), F.sum(chars(*cs)).alias("chars")).select(F.lit(kind).alias("kind"), "type", "n", "chars")
    return tally(a, "node", "label", "id", "name").unionByName(tally(b, "edge", "type", "id", "src", "dst"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lower("c_mktsegment"), F.lit("-"), F.when(k % 4 == 0, "smoke-").otherwise(""), k).alias("run"), (F.lit(10000) - F.floor(F.col("c_acctbal"))).alias("created"), (k % 17 == 0).alias("pinned"), (k % 23 == 0).alias("active"), (k % 2 == 0).alias("complete"), F.lit("local").alias("profile"))


@query(
    "prune_selection",
    "WITH r AS (SELECT lower(c_mktsegment) || '-' || CASE WHEN c_custkey % 4 = 0 THEN 'smoke-' ELSE '' END || c_custkey AS run, 10000 - floor(c_acctbal) AS created, c_custkey % 17 = 0 OR c_custkey % 23 = 0 AS safe, c_custkey % 4 = 0 AS smoke FROM customer), c AS (SELECT * FROM r WHERE run LIKE 'build%' AND smoke) "
    "SELECT run, CASE WHEN row_number() OVER (ORDER BY created DESC, run) <= 5 THEN 'protected' ELSE 'selected' END AS action FROM c WHERE NOT safe UNION ALL SELECT run, 'protected' FROM c WHERE safe",
)
def prune_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.prune(_runs(spark, sf_dir), pattern="build*", smoke=True, keep_latest=5)


@query(
    "run_inventory",
    "WITH f AS (SELECT DISTINCT o_custkey AS run, o_orderpriority AS file FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')), n AS (SELECT run, count(*) AS k FROM f GROUP BY run) "
    "SELECT c_custkey AS run, coalesce(k, 0) AS n_required, coalesce(k, 0) = 3 AS complete, CAST(row_number() OVER (ORDER BY floor(c_acctbal) DESC, c_custkey) AS INT) AS rank FROM customer LEFT JOIN n ON run = c_custkey",
)
def run_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), F.floor("c_acctbal").alias("created"))
    present = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("file"))
    return artifacts.inventory(runs, present, ["1-URGENT", "2-HIGH", "5-LOW"]).select("run", "n_required", "complete", "rank")


@query("verified_files", "SELECT 'doc' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS state FROM documents")
def verified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", node_id("doc", "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    found = d.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, "0").otherwise(F.col("sha256")).alias("sha256"))
    return artifacts.verified(d.select("path", "sha256"), found)


@query("byte_sizes", "SELECT p_partkey, CASE WHEN n < 1024 THEN CAST(n AS BIGINT) || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || ' KB' ELSE printf('%.1f', n / 1048576.0) || ' MB' END AS size FROM (SELECT p_partkey, p_partkey * p_partkey AS n FROM part)")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.byte_size(F.col("p_partkey") * F.col("p_partkey")).alias("size"))


@query("id_lists", "WITH x AS (SELECT 'PMC' || (p_partkey % 100) AS id, min(p_partkey) AS first FROM part GROUP BY p_partkey % 100) SELECT id, CAST(row_number() OVER (ORDER BY first) AS INT) AS pos FROM x ORDER BY first LIMIT 40")
def id_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "pmc").otherwise(" "), F.col("p_partkey") % 100).alias("value"))
    return readers.distinct_ids(lines, limit=40)


@query("question_records", "SELECT 'q' || lpad(CAST(row_number() OVER (ORDER BY item_id) AS VARCHAR), 4, '0') AS id, text AS question FROM benchmark")
def question_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.to_json(F.struct(F.col("text").alias("message"))).alias("value"))
    return readers.question_records(b).select("id", "question")


@query("bioc_passages", "SELECT doc_id, CAST(ord AS INT) AS ord, text FROM (SELECT doc_id, unnest(range(0, len(l))) AS ord, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(text) <> ''")
def bioc_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nested JSON, read back as passages."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(0).alias("offset"), x.alias("text"))).alias("passages"))
    nested = d.select("doc_id", F.to_json(F.struct(F.array(F.struct(F.col("passages"))).alias("documents"))).alias("payload"))
    return readers.passages(nested, "payload", "doc_id").where(F.trim("text") != "").select("doc_id", "ord", "text")
