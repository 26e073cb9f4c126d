"""Answers from evidence rows: (q, pos, id, source, type, target, target_label, kind, text, confidence, path_id, path_step, path_length)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import dims
from ..functions import text as T


def deduplicated(evidence: DataFrame, by: str = "q") -> DataFrame:
    """The first evidence of each (source, type, target, kind), names normalised."""
    key = [T.normalize_term(F.col("source")), F.upper("type"), T.normalize_term(F.col("target")), F.lower("kind")]
    return evidence.withColumn("_r", F.row_number().over(W.partitionBy(by, *key).orderBy("pos"))).where("_r = 1").drop("_r")


def reasoning(evidence: DataFrame, by: str = "q") -> DataFrame:
    """Evidence in reasoning order: paths by first occurrence, then step, then place; adds path_order and step_order."""
    path = F.coalesce(F.nullif("path_id", F.lit("")), "id")
    first = evidence.withColumn("_p", path).withColumn("_f", F.min("pos").over(W.partitionBy(by, "_p")))
    out = first.withColumn("path_order", F.dense_rank().over(W.partitionBy(by).orderBy("_f")) - 1)
    return out.withColumn("step_order", F.row_number().over(W.partitionBy(by).orderBy("path_order", "path_step", "pos"))).drop("_p", "_f")


def required(evidence: DataFrame, by: str = "q") -> DataFrame:
    """Evidence that an answer must mention: the first two rows, and the first definition."""
    place = F.row_number().over(W.partitionBy(by).orderBy("pos"))
    of_kind = F.row_number().over(W.partitionBy(by, F.lower("kind")).orderBy("pos"))
    return evidence.withColumns({"_a": place, "_b": of_kind}).where("_a <= 2 or (lower(kind) = 'definition' and _b = 1)").drop("_a", "_b")


def requested(question: Column) -> Column:
    """Relationship types that an extractive answer may state."""
    cues = [(["risk"], ["INCREASES_RISK_OF", "MAY_INCREASE_RISK_OF"]), (dims.INTENTS[1][0], ["REDUCES", "MAY_REDUCE"]), (dims.INTENTS[2][0], dims.INTENTS[2][1]), (["interact", "interaction"], ["INTERACTS_WITH", "MAY_INTERACT_WITH"])]
    out = F.array().cast("array<string>")
    for words, types in reversed(cues):
        out = F.when(T.has_any(question, words), F.array(*[F.lit(t) for t in types])).otherwise(out)
    return out


def wanted_label(question: Column) -> Column:
    has = lambda *w: T.has_any(question, list(w))
    return F.when(has("biomarker"), "biomarker").when(has("drug", "medication"), "drug").when(has("condition", "disease", "risk"), "condition").otherwise("")


def answers(questions: DataFrame, evidence: DataFrame, model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(q, answer, mode, confidence, abstained) for questions (q, question).

    Without evidence: abstain.  Else the first that applies: an extractive graph answer, an extractive
    definition, the model (a function from (q, question, evidence sentences) to (q, answer)), a
    summary.  A model's answer is completed by the required evidence that it does not mention.
    """
    e = deduplicated(evidence).withColumn("_s", T.sentence(F.upper("type"), F.col("source"), F.col("target")))
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", "source", "type", "target", "target_label", "kind", "confidence", F.col("_s").alias("s"))))
    q = questions.join(e.groupBy("q").agg(rows.alias("ev"), F.min("confidence").alias("least")), "q", "left").withColumn("n", T.normalize_term(F.col("question")))
    types, label = requested(F.col("n")), wanted_label(F.col("n"))
    named = F.filter(
        "ev",
        lambda x: (F.lower(x["kind"]) == "graph") & F.array_contains(types, F.upper(x["type"])) & ((label == "") | (F.lower(x["target_label"]) == label)) & ((T.normalize_term(x["source"]) == "") | F.contains("n", T.normalize_term(x["source"]))),
    )
    q = q.withColumn("_g", F.when(F.contains("n", F.lit("graph")), named).otherwise(F.filter("ev", lambda x: F.lit(False))))
    first = F.upper(F.get("_g", F.lit(0))["type"])
    sources = T.join_names(F.array_sort(F.array_distinct(F.transform("_g", lambda x: x["source"]))))
    targets = T.join_names(F.transform("_g", lambda x: x["target"]))
    verb = F.when(first.isin("REDUCES", "MAY_REDUCE"), "reduce").when(first.isin("INCREASES_RISK_OF", "MAY_INCREASE_RISK_OF"), "increase the risk of").when(first.isin("INCREASES", "MAY_INCREASE"), "increase").when(first.isin("INTERACTS_WITH", "MAY_INTERACT_WITH"), "interact with")
    graph = F.when(F.size("_g") > 0, F.concat(F.lit("In the retrieved graph, "), sources, F.lit(" may "), verb, F.lit(" "), targets, F.lit(".")))
    defs = F.filter("ev", lambda x: F.lower(x["kind"]) == "definition")
    facts = F.filter("ev", lambda x: F.lower(x["kind"]) == "graph")
    told = F.concat(F.get(defs, F.lit(0))["s"], F.when(F.size(facts) > 0, F.concat(F.lit(" Graph evidence summary: "), F.get(facts, F.lit(0))["s"])).otherwise(""))
    definition = F.when(T.has_any(F.col("n"), dims.DEFINITION_CUES) & (F.size(defs) > 0), told)
    summary = F.array_join(F.transform("ev", lambda x: x["s"]), " ")
    q = q.withColumns({"_graph": graph, "_definition": definition, "_summary": summary})
    if model is not None:
        said = model(q.where("ev is not null and _graph is null and _definition is null").select("q", "question", F.transform("ev", lambda x: x["s"]).alias("sentences")))
        q = q.join(said.select("q", F.col("answer").alias("_said")), "q", "left")
        need = F.filter("ev", lambda x: ((x["pos"] <= F.element_at("ev", F.least(F.size("ev"), F.lit(2)))["pos"]) | ((F.lower(x["kind"]) == "definition") & (x["id"] == F.get(defs, F.lit(0))["id"]))) & ~T.answer_mentions(T.normalize_term(F.col("_said")), x["source"], x["type"], x["target"]))
        q = q.withColumn("_said", F.when(F.size(need) > 0, F.concat("_said", F.lit(" Evidence summary: "), F.array_join(F.transform(need, lambda x: x["s"]), " "))).otherwise(F.col("_said")))
    else:
        q = q.withColumn("_said", F.lit(None).cast("string"))
    mode = F.when(F.col("ev").isNull(), "abstained").when(F.col("_graph").isNotNull(), "graph").when(F.col("_definition").isNotNull(), "definition").when(F.col("_said").isNotNull(), "model").otherwise("summary")
    text = F.when(F.col("ev").isNull(), dims.ABSTAINED).otherwise(F.coalesce("_graph", "_definition", "_said", "_summary"))
    return q.select("q", text.alias("answer"), mode.alias("mode"), F.coalesce("least", F.lit(0.0)).alias("confidence"), F.col("ev").isNull().alias("abstained"))


def grouped_steps(steps: DataFrame, by: str = "q") -> DataFrame:
    """(by, path_id, length, steps): reasoning steps of each path in order, as a list of source -> target."""
    each = steps.groupBy(by, "path_id").agg(F.max("path_length").alias("length"), F.array_sort(F.collect_list(F.struct("path_step", "pos", F.concat_ws(" -> ", "source", "target").alias("s")))).alias("x"))
    return each.select(by, "path_id", "length", F.transform("x", lambda s: s["s"]).alias("steps"))
