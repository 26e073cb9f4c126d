"""Scores of questions from their records, the manifest of a run, what was retrieved, and what was answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import evaluate

META = "metadata"
#: Texts that stand in results.
MISSING_MANIFEST = "missing manifest row"
JUDGE_OFF = "disabled"


def _given(*names: str) -> Column:
    """The first of the metadata that says something; empty texts and lists, 0 and false do not."""
    at = [F.element_at(META, n) for n in names]
    return F.coalesce(*[F.when(~F.trim(v).isin("", "[]", "{}", "0", "false", "null"), v) for v in at])


def _items(v: Column) -> Column:
    """The non-empty items of a JSON list, or of a text cut at semicolons."""
    listed = F.coalesce(F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>")), F.split(v, ";"))
    return F.coalesce(F.filter(F.transform(listed, T.clean), lambda x: x != ""), F.array().cast("array<string>"))


def _flag(name: str, other: str) -> Column:
    value = F.when(F.map_contains_key(META, name), F.element_at(META, name)).otherwise(F.element_at(META, other))
    return F.lower(T.clean(value)).isin("1", "true", "yes", "y")


def expectations(questions: DataFrame) -> DataFrame:
    """(q, question, question_type, split, facts, entities, relationships, ids, kinds, unanswerable, hops) of question records."""
    none = F.array().cast("array<string>")
    own = questions.select(F.col("id").alias("q"), "question", *[F.coalesce(c, none).alias(c) for c in ("facts", "entities", "relationships")], META)
    unanswerable = _flag("unanswerable", "expected_abstention")
    told = F.coalesce(_given("expected_hop_count"), F.element_at(META, "hop_count"))
    default = F.when(~unanswerable & (F.size("relationships") > 0), 1).otherwise(0)
    hops = F.when(told.isNull(), default).otherwise(F.greatest(F.lit(0), F.coalesce(F.trim(told).try_cast("int"), F.lit(1))))
    wanted = lambda flag, kind: F.when(flag, F.array(F.lit(kind))).otherwise(none)
    kinds = F.concat(
        F.transform(F.concat(_items(F.element_at(META, "required_evidence_kinds")), _items(F.element_at(META, "expected_evidence_kinds"))), F.lower),
        wanted(_flag("requires_definition", "requires_standard_definition"), "definition"),
        wanted(_flag("requires_graph_evidence", "requires_pmc_evidence"), "graph"),
    )
    ids = F.concat(
        _items(_given("expected_evidence_ids", "required_evidence_ids", "relationship_gold_ids", "related_relationship_gold_id")),
        _items(_given("expected_chunk_ids", "required_chunk_ids", "chunk_id")),
    )
    return own.select(
        "q", "question", T.clean(_given("question_type", "category")).alias("question_type"), T.clean(F.element_at(META, "split")).alias("split"),
        "facts", "entities", "relationships", ids.alias("ids"), F.array_sort(F.array_distinct(kinds)).alias("kinds"), unanswerable.alias("unanswerable"), hops.alias("hops"),
    )


def retrieved(evidence: DataFrame) -> DataFrame:
    """(q, n, longest, definition, seen): counts of each question's evidence, and the kinds seen."""
    kind = F.lower(T.clean(F.col("evidence_kind")))
    return evidence.groupBy("q").agg(
        F.count("*").alias("n"),
        F.max(_at_least_one("path_length")).alias("longest"),
        F.bool_or((kind == "definition") & (T.clean(F.col("evidence_text")) != "")).alias("definition"),
        F.collect_set(F.nullif(kind, F.lit(""))).alias("seen"),
    )


def _at_least_one(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("int"), F.lit(0)), F.lit(1))


def id_hits(expected: DataFrame, evidence: DataFrame) -> DataFrame:
    """(q): questions one of whose expected ids is that of an evidence row, its chunk or its relationship."""
    want = expected.select("q", F.explode("ids").alias("item")).distinct()
    have = evidence.select("q", F.explode(F.array(*[T.clean(F.col(c)) for c in ("id", "chunk_id", "relationship_id")])).alias("item"))
    return want.join(have, ["q", "item"], "left_semi").select("q").distinct()


def question_scores(questions: DataFrame, manifest: DataFrame, evidence: DataFrame, answers: DataFrame, sources: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row of scores for each question.

    ``questions``: as of ``readers.question_records``.  ``manifest``: (id, status, answer_status, retrieved_count, source_count,
    abstained, error) as text.  ``evidence``: (q, id, chunk_id, relationship_id, source_name, relationship_type, target_name, path_id,
    path_step, path_length, evidence_kind, evidence_text).  ``answers``: (id, answer, abstained).  ``sources``: (q, evidence_kind).
    ``aliases``: (g, item).  Ids are unique in the first, second and fourth.  A question without a manifest row is an
    error with nothing found; one without an answer has an empty one and the manifest's word on whether it abstained.
    """
    want = expectations(questions)
    steps = evidence.withColumns({"path_id": T.clean(F.col("path_id")), "path_step": _at_least_one("path_step"), "path_length": _at_least_one("path_length")})
    found = {
        "entity": evaluate.coverage(want.select("q", F.explode("entities").alias("item")), evidence.select("q", F.explode(F.array("source_name", "target_name")).alias("item")), aliases),
        "relationship": evaluate.coverage(want.select("q", F.explode("relationships").alias("item")), evidence.select("q", F.col("relationship_type").alias("item")), aliases, widen_observed=False),
    }
    rows = want.join(manifest.select(F.col("id").alias("q"), F.lit(True).alias("known"), "status", "answer_status", F.col("retrieved_count").alias("_retrieved"), F.col("source_count").alias("_source"), F.col("abstained").alias("_abstained"), "error"), "q", "left")
    rows = rows.join(answers.select(F.col("id").alias("q"), T.clean(F.col("answer")).alias("answer"), F.coalesce("abstained", F.lit(False)).alias("_said")), "q", "left")
    rows = rows.join(retrieved(evidence), "q", "left").join(evaluate.path_complete(steps, want.select("q", "hops")), "q", "left")
    rows = rows.join(sources.groupBy("q").agg(F.count("*").alias("cited"), F.collect_set(F.nullif(F.lower(T.clean(F.col("evidence_kind"))), F.lit(""))).alias("cited_kinds")), "q", "left")
    rows = rows.join(id_hits(want, evidence).withColumn("id_hit", F.lit(True)), "q", "left")
    for side, hits in found.items():
        rows = rows.join(hits.select("q", F.col("hits").alias(f"{side}_hits"), F.col("total").alias(f"{side}_total"), F.col("coverage").alias(f"{side}_coverage")), "q", "left")
        rows = rows.withColumns({f"{side}_hits": F.coalesce(f"{side}_hits", F.lit(0)), f"{side}_total": F.coalesce(f"{side}_total", F.lit(0)), f"{side}_coverage": F.coalesce(f"{side}_coverage", F.lit(1.0))})
    none = F.array().cast("array<string>")
    count = lambda c: F.coalesce(F.trim(c).try_cast("long"), F.lit(0))
    facts = F.filter(F.transform("facts", T.light), lambda x: x != "")
    matched = F.filter(facts, lambda f: T.fact_matches(f, T.light(F.col("answer"))))
    rows = rows.withColumns({"answer": F.coalesce("answer", F.lit("")), "retrieved_count": F.coalesce("n", F.lit(0)), "source_count": F.coalesce("cited", F.lit(0))})
    rows = rows.withColumns(
        {
            "expected_fact_total": F.size(facts), "expected_fact_hits": F.size(matched),
            "abstained": F.when(F.col("answer_status") == "skipped", F.col("retrieved_count") == 0).otherwise(F.coalesce("_said", F.lower(T.clean(F.col("_abstained"))) == "true")),
            "evidence_hit": (F.size("ids") == 0) | F.coalesce("id_hit", F.lit(False)),
            "retrieved_kinds": evaluate.kinds_hit(F.col("kinds"), F.coalesce("seen", none)), "source_kinds": evaluate.kinds_hit(F.col("kinds"), F.coalesce("cited_kinds", none)),
        }
    )
    rows = rows.withColumn("fact_coverage", F.when(F.col("expected_fact_total") > 0, F.round(F.col("expected_fact_hits") / F.col("expected_fact_total"), 6)).otherwise(1.0))
    rows = evaluate.score_questions(rows)
    known = F.coalesce("known", F.lit(False))
    or_else = lambda c, v: F.when(known, c).otherwise(F.lit(v))
    flag = lambda c: or_else(F.col(c), False)
    text = lambda c, v="": or_else(F.coalesce(c, F.lit("")), v)
    asked = {"expected_fact": "facts", "entity": "entities", "relationship": "relationships"}
    coverages = {}
    for side, items in asked.items():
        name = "fact" if side == "expected_fact" else side
        coverages |= {
            f"{side}_hits": or_else(F.col(f"{side}_hits").cast("long"), 0), f"{side}_total": F.when(known, F.col(f"{side}_total")).otherwise(F.size(items)).cast("long"),
            f"{name}_coverage": F.when(known, F.col(f"{name}_coverage")).when(F.size(items) > 0, 0.0).otherwise(1.0),
        }
    out = {
        "question_id": F.col("q"), "question": F.col("question"), "question_type": F.col("question_type"), "split": F.col("split"),
        "status": text("status", "error"), "answer_status": text("answer_status", "missing"), "retrieved_count": or_else(count("_retrieved"), 0), "source_count": or_else(count("_source"), 0),
        "hop_count": F.col("hops"), "max_retrieved_path_length": or_else(F.coalesce("longest", F.lit(0)), 0), "path_complete": flag("path_complete"), "definition_source_hit": or_else(F.coalesce("definition", F.lit(False)), False),
        "required_evidence_kinds": F.array_join("kinds", ";"), "retrieved_required_evidence_kinds": flag("retrieved_kinds"), "source_required_evidence_kinds": flag("source_kinds"), **coverages,
        "expected_evidence_hit": flag("evidence_hit"), "retrieval_success": flag("retrieval_success"), "citation_supported": flag("citation_supported"), "abstained": flag("abstained"),
        "expected_abstention": F.col("unanswerable"), "abstention_correct": flag("abstention_correct"), "unsupported_answer": flag("unsupported_answer"),
        "llm_judge_status": F.lit(JUDGE_OFF), "llm_judge_supported": F.lit(""), "llm_judge_score": F.lit(""), "llm_judge_notes": F.lit(""),
        "answer_success": flag("answer_success"), "error": text("error", MISSING_MANIFEST),
    }
    return rows.select(*[c.alias(k) for k, c in out.items()])
