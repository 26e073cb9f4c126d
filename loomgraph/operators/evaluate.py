"""Scores of extraction (precision, recall, F1) and of question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: the error of a chunk whose document is not known.
UNKNOWN_DOCUMENT = "Chunk references unknown document_id: "


def outcomes(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, outcome): tp, fp or fn for each distinct key of either side, by one full outer join."""
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(True))
    p = predicted.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_p", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = g.join(p, on, "full_outer")
    outcome = F.when(F.col("_g") & F.col("_p"), "tp").when(F.col("_p"), "fp").otherwise("fn")
    return both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], outcome.alias("outcome"))


def _ratios(counted: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative"))
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counted.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)})


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == k).alias(n) for k, n in (("tp", "true_positive"), ("fp", "false_positive"), ("fn", "false_negative"))]


def metrics(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and ratios of the outcomes, per bucket if asked for."""
    return _ratios(matched.groupBy(*(by or [])).agg(*_counts()))


def metrics_table(entities: DataFrame, relations: DataFrame, entity_label: str, relation_label: str) -> DataFrame:
    """(scope, label, counts, ratios): overall, both scopes and their labels from one grouping-sets aggregate.

    Overall is micro: the counts of entities and relationships are added before the ratios.
    """
    both = entities.select(F.lit("entities").alias("scope"), F.col(entity_label).alias("label"), "outcome").unionByName(relations.select(F.lit("relationships").alias("scope"), F.col(relation_label).alias("label"), "outcome"))
    sums = both.groupingSets([[F.col("scope"), F.col("label")], [F.col("scope")], []], "scope", "label").agg(*_counts(), F.grouping_id().alias("_id"))
    scope = F.when(F.col("_id") == 3, "overall").when(F.col("_id") == 1, F.col("scope")).when(F.col("scope") == "entities", "entity_type").otherwise("relationship_type")
    out = sums.withColumn("_s", scope).select(F.col("_s").alias("scope"), F.coalesce("label", F.lit("")).alias("label"), "true_positive", "false_positive", "false_negative")
    return _ratios(out)


def macro_f1(matched: DataFrame, document: str) -> DataFrame:
    """Mean F1 over documents (an extension beside the micro figures)."""
    return metrics(matched, [document]).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def path_complete(evidence: DataFrame, hops: DataFrame) -> DataFrame:
    """(q, path_complete): for 0 hops there is no evidence, for 1 any, for more a path with as many distinct steps."""
    paths = evidence.groupBy("q", F.coalesce(F.nullif("path_id", F.lit("")), "id").alias("p")).agg(F.count_distinct("path_step").alias("steps"), F.max("path_length").alias("length"))
    most = paths.groupBy("q").agg(F.max(F.least("steps", "length")).alias("most"), F.count("*").alias("any"))
    out = hops.join(most, "q", "left")
    hit = F.when(F.col("hops") <= 0, F.col("any").isNull()).when(F.col("hops") == 1, F.col("any").isNotNull()).otherwise(F.coalesce(F.col("most") >= F.col("hops"), F.lit(False)))
    return out.select("q", hit.alias("path_complete"))


def coverage(expected: DataFrame, observed: DataFrame, aliases: DataFrame | None = None, widen_observed: bool = True) -> DataFrame:
    """(q, hits, total, coverage): expected (q, item) found among observed (q, item), names or any of their aliases equal.

    ``aliases``: (g, item), the groups of names that count as one; ``widen_observed``: for the observed names too.
    """
    e = expected.select("q", T.light(F.col("item")).alias("item")).where("item <> ''")
    o = observed.select("q", T.light(F.col("item")).alias("item")).where("item <> ''").distinct()

    def widened(rows: DataFrame, keep: list[str]) -> DataFrame:
        if aliases is None:
            return rows.withColumn("v", F.col("item"))
        a = aliases.select("g", T.light(F.col("item")).alias("_i"))
        other = rows.join(a, F.col("item") == F.col("_i")).select(*keep, "g").join(a.withColumnRenamed("_i", "v"), "g").select(*keep, "v")
        return rows.select(*keep, F.col("item").alias("v")).unionByName(other).distinct()

    e = e.groupBy("q", "item").agg(F.count("*").alias("times"))
    hit = widened(e, ["q", "item"]).join((widened(o, ["q"]) if widen_observed else o.withColumnRenamed("item", "v")).select(F.col("q").alias("_q"), F.col("v").alias("_v")), (F.col("q") == F.col("_q")) & (F.col("v") == F.col("_v"))).select("q", "item").distinct().withColumn("hit", F.lit(1))
    return e.join(hit, ["q", "item"], "left").groupBy("q").agg(F.sum(F.col("times") * F.coalesce("hit", F.lit(0))).alias("hits"), F.sum("times").alias("total")).withColumn("coverage", F.round(F.col("hits") / F.col("total"), 6))


def kinds_hit(required: Column, observed: Column) -> Column:
    """Every required kind of evidence was observed."""
    return F.size(F.array_except(required, observed)) == 0


def ids_hit(expected: Column, observed: Column) -> Column:
    """Any of the expected ids was observed; true if none is expected."""
    return (F.size(expected) == 0) | F.arrays_overlap(expected, observed)


def score_questions(rows: DataFrame) -> DataFrame:
    """Adds retrieval_success, citation_supported, unsupported_answer, answer_success, abstention_correct.

    ``rows`` carries the facts of each question: status, answer_status, retrieved_count, source_count, the
    three coverages, evidence_hit, path_complete, retrieved_kinds, source_kinds, abstained, unanswerable, answer.
    """
    ok = (F.col("retrieved_count") > 0) & (F.col("entity_coverage") >= 1) & (F.col("relationship_coverage") >= 1) & F.col("evidence_hit") & F.col("path_complete") & F.col("retrieved_kinds")
    out = rows.withColumn("retrieval_success", F.when(F.col("unanswerable"), F.col("retrieved_count") == 0).otherwise(ok))
    out = out.withColumn("citation_supported", F.when(~F.col("unanswerable") & ~F.col("abstained"), (F.col("source_count") > 0) & F.col("source_kinds")).otherwise(F.col("abstained")))
    out = out.withColumn("unsupported_answer", (F.coalesce("answer", F.lit("")) != "") & ~F.col("abstained") & ~F.col("retrieval_success"))
    good = F.when(F.col("unanswerable"), F.col("abstained")).otherwise(~F.col("abstained") & (F.col("fact_coverage") >= 1) & F.col("citation_supported") & ~F.col("unsupported_answer"))
    out = out.withColumn("answer_success", F.when(F.col("answer_status") == "skipped", F.lit(False)).otherwise(good))
    return out.withColumn("abstention_correct", F.col("abstained") == F.col("unanswerable"))


def _rate(test: Column, of: Column | None = None) -> Column:
    hit, all_ = F.count_if(test if of is None else test & of), F.count("*") if of is None else F.count_if(of)
    return F.round(F.when(all_ > 0, hit / all_).otherwise(0.0), 6)


def qa_metrics(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Rates over all questions and over sub-populations; an empty population gives 0.  ``by``: per label, "" as unspecified."""
    kinds = F.split("required_kinds", ";")
    needs_definition, needs_both = F.array_contains(kinds, "definition"), F.array_contains(kinds, "definition") & F.array_contains(kinds, "graph")
    group = [F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("unspecified")).alias("label")] if by else []
    mean = lambda c: F.coalesce(F.round(F.avg(c), 6), F.lit(0.0))
    return rows.groupBy(*group).agg(
        F.count("*").alias("question_count"),
        F.count_if(F.col("status") == "ok").alias("success_count"),
        F.count_if(F.col("status") != "ok").alias("error_count"),
        _rate(F.col("retrieval_success")).alias("retrieval_recall"),
        _rate(F.col("answer_success")).alias("answer_accuracy"),
        _rate(F.col("abstention_correct")).alias("abstention_accuracy"),
        _rate(F.col("citation_supported")).alias("citation_support_rate"),
        _rate(F.col("unsupported_answer")).alias("unsupported_answer_rate"),
        mean("fact_coverage").alias("mean_fact_coverage"),
        mean("entity_coverage").alias("mean_entity_coverage"),
        mean("relationship_coverage").alias("mean_relationship_coverage"),
        _rate(F.col("path_complete")).alias("path_complete_rate"),
        _rate(F.col("retrieved_kinds")).alias("required_evidence_kind_recall"),
        _rate(F.col("source_kinds")).alias("required_evidence_kind_citation_rate"),
        _rate(F.col("retrieval_success"), F.col("hops") > 1).alias("multi_hop_retrieval_recall"),
        _rate(F.col("retrieval_success"), needs_definition).alias("definition_required_retrieval_recall"),
        _rate(F.col("citation_supported"), needs_both).alias("mixed_evidence_citation_rate"),
    )


def judge_report(judged: DataFrame) -> DataFrame:
    """(judged_count, supported_rate, mean_score) over the rows judged without error."""
    ok = judged.where("error is null")
    return ok.agg(F.count("*").alias("judged_count"), _rate(F.col("supported")).alias("supported_rate"), F.coalesce(F.round(F.avg("score"), 6), F.lit(0.0)).alias("mean_score"))


def selected_chunks(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks to evaluate: with an id and not excluded, by paper, order and id."""
    out = chunks.where((T.clean(F.col("chunk_id")) != "") & (F.lower(T.clean(F.col("included_in_gold_annotation"))) != "no")).orderBy("pmcid", "chunk_index", "chunk_id")
    return out.limit(limit) if limit is not None else out


def last_by_id(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each id once: the last row's values at the first row's place; rows without an id all stay, after the others."""
    named = rows.where(F.coalesce(key, F.lit("")) != "")
    rest = [c for c in rows.columns if c not in (key, order)]
    last = named.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x"), F.min(order).alias("place")).select(F.lit(0).alias("late"), "place", key, "x.*")
    free = rows.where(F.coalesce(key, F.lit("")) == "").select(F.lit(1).alias("late"), F.col(order).alias("place"), key, *rest)
    return last.unionByName(free)


def assembled(documents: DataFrame, chunks: DataFrame, key: str = "doc") -> DataFrame:
    """One nested row per document with its chunks in order."""
    each = chunks.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct(*[c for c in chunks.columns if c != key]))).alias("chunks"))
    return documents.join(each, F.col(key) == F.col("_k"), "left").drop("_k")


def chunk_results(chunks: DataFrame, documents: DataFrame, extracted: DataFrame) -> DataFrame:
    """(chunk_id, document_id, pmcid, status, entity_count, relationship_count, rejected_candidate_count, model_call_count, error).

    Chunks (chunk_id, document_id, pmcid) with the outcome of their extraction (chunk_id, the four counts, error): a chunk of an
    unknown document is an error and has no ids but its own; one that was not extracted yet is pending; counts are those of "ok" alone.
    """
    known = documents.select(F.col("document_id").alias("_d")).distinct()
    counts = ["entity_count", "relationship_count", "rejected_candidate_count", "model_call_count"]
    own = extracted.select(F.col("chunk_id").alias("_c"), *[F.col(c).cast("long").alias(c) for c in counts], F.coalesce("error", F.lit("")).alias("_e"))
    rows = chunks.select("chunk_id", "document_id", "pmcid").join(known, F.col("document_id") == F.col("_d"), "left").join(own, F.col("chunk_id") == F.col("_c"), "left")
    lost = F.col("_d").isNull()
    status = F.when(lost, "error").when(F.col("_c").isNull(), "pending").when(F.col("_e") != "", "error").otherwise("ok")
    error = F.when(lost, F.concat(F.lit(UNKNOWN_DOCUMENT), F.coalesce("document_id", F.lit("")))).otherwise(F.coalesce("_e", F.lit("")))
    return rows.select("chunk_id", *[F.when(~lost, F.col(c)).alias(c) for c in ("document_id", "pmcid")], status.alias("status"), *[F.when(status == "ok", F.col(c)).alias(c) for c in counts], error.alias("error"))


def result_counts(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(chunk_count, success_count, error_count) of results with a status, per bucket if asked for."""
    return results.groupBy(*(by or [])).agg(F.count("*").alias("chunk_count"), F.count_if(F.col("status") == "ok").alias("success_count"), F.count_if(F.col("status") == "error").alias("error_count"))
