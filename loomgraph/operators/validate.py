"""Validation of extracted entities and relationships against the ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T

#: Reasons of rejection, in the order in which they are tested.
REASONS = [
    "relationship type is not in the ontology",
    "relationship endpoint is invalid",
    "relationship direction is invalid for the ontology",
    "relationship confidence is missing or invalid",
    "relationship evidence is required",
    "relationship confidence is outside the accepted range",
]


def entities(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (doc, seq, type, name, ...): valid entities with ids (the last of an id counts), and rejected rows."""
    typed = raw.withColumns({"type": T.canonical(F.col("type"), dims.NODE_LABELS), "name": T.clean(F.col("name"))})
    ok = F.col("type").isin(dims.ENTITY_TYPES) & (F.col("name") != "")
    good = typed.where(ok).withColumn("id", T.entity_id(F.col("type"), F.col("name")))
    last = good.groupBy("doc", "id").agg(F.max_by(F.struct("type", "name"), "seq").alias("e")).select("doc", "id", "e.type", "e.name")
    bad = typed.where(~ok).select("doc", F.concat_ws(":", "type", "name").alias("text"), F.lit("entity has unsupported type or missing name").alias("reason"))
    return last, bad


def relationships(raw: DataFrame, min_confidence: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """From (doc, pmcid, chunk_id, type, s_type, s_name, t_type, t_name, confidence, evidence): valid ones with ids, and
    rejected rows with the first reason that applies.

    The ontology is a broadcast table of 40 rows.  A confidence of NaN is outside the range.
    """
    up = raw.withColumns(
        {"type": F.upper(T.clean(F.col("type"))), "s_type": T.canonical(F.col("s_type"), dims.NODE_LABELS), "t_type": T.canonical(F.col("t_type"), dims.NODE_LABELS), "s_name": T.clean(F.col("s_name")), "t_name": T.clean(F.col("t_name")), "evidence": T.clean(F.col("evidence")), "_c": F.col("confidence").try_cast("double")}
    )
    allowed = F.broadcast(dims.directions(raw.sparkSession).select(F.col("type").alias("_ty"), F.col("source_type").alias("_s"), F.col("target_type").alias("_t"), F.lit(True).alias("_ok")))
    up = up.join(allowed, (F.col("type") == F.col("_ty")) & (F.col("s_type") == F.col("_s")) & (F.col("t_type") == F.col("_t")), "left")
    end = lambda p: (F.col(f"{p}_type") == "Paper") | (F.col(f"{p}_type").isin(dims.ENTITY_TYPES) & (F.col(f"{p}_name") != ""))
    tests = [~F.col("type").isin(list(dims.DIRECTIONS)), ~(end("s") & end("t")), F.col("_ok").isNull(), F.col("_c").isNull(), F.col("evidence") == "", ~F.col("_c").between(min_confidence, 1.0)]
    reason = F.when(tests[0], REASONS[0])
    for test, why in zip(tests[1:], REASONS[1:], strict=True):
        reason = reason.when(test, why)
    up = up.withColumn("reason", reason)
    node = lambda p: F.when(F.col(f"{p}_type") == "Paper", F.col("doc").cast("string")).otherwise(T.entity_id(F.col(f"{p}_type"), F.col(f"{p}_name")))
    good = up.where("reason is null").withColumns({"src": node("s"), "dst": node("t")})
    good = good.withColumn("id", T.key_of("rel:", F.col("src"), F.col("type"), F.col("dst"), F.col("pmcid"), F.col("chunk_id"), F.col("evidence")))
    good = good.select("doc", "id", "type", "src", "dst", "s_type", "s_name", "t_type", "t_name", F.col("_c").alias("confidence"), "evidence", "pmcid", "chunk_id").dropDuplicates(["doc", "id"])
    bad = up.where("reason is not null").select("doc", F.concat_ws(" ", "s_name", "type", "t_name").alias("text"), "reason")
    return good, bad


def with_endpoints(entity_rows: DataFrame, relation_rows: DataFrame) -> DataFrame:
    """The entities and those ends of valid relationships that are not among them."""
    ends = relation_rows.select("doc", F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("s_type").alias("type"), F.col("s_name").alias("name")), F.struct(F.col("dst").alias("id"), F.col("t_type").alias("type"), F.col("t_name").alias("name")))).alias("e"))
    ends = ends.select("doc", "e.*").where(F.col("type") != "Paper").groupBy("doc", "id").agg(F.min(F.struct("type", "name")).alias("e")).select("doc", "id", "e.type", "e.name")
    return entity_rows.unionByName(ends.join(entity_rows.select("doc", "id"), ["doc", "id"], "left_anti"))
