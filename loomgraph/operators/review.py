"""The review of annotations: issues, summaries, responses, and the export of gold rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T

#: Messages of the checks.
ISSUES = {
    "chunk_missing": ("chunks", "chunk_id", "Chunk row is missing chunk_id."),
    "chunk_duplicate": ("chunks", "chunk_id", "Duplicate chunk_id in chunks sheet."),
    "chunk_open": ("chunks", "annotation_status", "Chunk is still unresolved; mark reviewed or accepted before gold export."),
    "entity_open": ("gold_entities", "annotation_status", "Entity row is still unresolved."),
    "entity_type": ("gold_entities", "entity_type", "Invalid entity type"),
    "entity_text": ("gold_entities", "entity_text", "Accepted entity is missing entity_text."),
    "entity_chunk": ("gold_entities", "chunk_id", "Accepted entity references an unknown chunk."),
    "entity_evidence": ("gold_entities", "evidence_text", "Accepted entity evidence_text or offsets do not match the chunk text."),
    "relation_open": ("gold_relationships", "annotation_decision", "Relationship row is still unresolved."),
    "relation_type": ("gold_relationships", "relationship_type", "Invalid relationship type"),
    "relation_chunk": ("gold_relationships", "chunk_id", "Accepted relationship references an unknown chunk."),
    "relation_evidence": ("gold_relationships", "evidence_text", "Accepted relationship evidence_text or offsets do not match the chunk text."),
    "relation_direction": ("gold_relationships", "direction_verified", "Accepted relationship must have direction_verified=yes."),
    "relation_negated": ("gold_relationships", "negated", "Accepted relationship must have negated=no."),
    "relation_speculative": ("gold_relationships", "speculative", "Accepted relationship must have speculative=no."),
    "relation_implied": ("gold_relationships", "explicit_or_implied", "Weakly implied relationships are not exported to the core gold set."),
    "relation_source": ("gold_relationships", "source_entity_id", "Accepted relationship source endpoint does not map to an accepted entity in the same chunk."),
    "relation_target": ("gold_relationships", "target_entity_id", "Accepted relationship target endpoint does not map to an accepted entity in the same chunk."),
}


def status(c: str) -> Column:
    return T.clean(F.col(c))


def unresolved(c: str = "annotation_status") -> Column:
    return status(c).isin(dims.UNRESOLVED)


def entity_accepted() -> Column:
    return status("annotation_status") == "accepted"


def relation_accepted() -> Column:
    return entity_accepted() & (status("annotation_decision") == "include")


def _issues(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row per failed test of a row."""
    each = F.filter(F.array(*[F.when(t, F.struct(*[F.lit(x).alias(n) for n, x in zip(("sheet", "field", "message"), ISSUES[k], strict=True)])) for k, t in tests.items()]), lambda x: x.isNotNull())
    return rows.select("row_number", T.clean(F.col("chunk_id")).alias("chunk_id"), F.explode(each).alias("x")).select("x.sheet", "row_number", "chunk_id", "x.field", "x.message")


def accepted_endpoints(entities: DataFrame) -> DataFrame:
    """(chunk, k): the keys by which an accepted entity can be named: id, type and text, type and normalised name."""
    low = lambda *c: F.concat_ws("|", *[F.lower(T.clean(F.col(x))) for x in c])
    name = F.coalesce(F.nullif(T.clean(F.col("normalized_name")), F.lit("")), T.clean(F.col("entity_text")))
    keys = F.array(F.when(status("entity_id") != "", F.concat(F.lit("id:"), status("entity_id"))), F.when((status("entity_type") != "") & (status("entity_text") != ""), F.concat(F.lit("t:"), low("entity_type", "entity_text"))), F.when((status("entity_type") != "") & (name != ""), F.concat(F.lit("n:"), F.lower(status("entity_type")), F.lit("|"), F.lower(name))))
    return entities.where(entity_accepted()).select(status("chunk_id").alias("_chunk"), F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("_k")).distinct()


def with_endpoint(relations: DataFrame, keys: DataFrame, side: str) -> DataFrame:
    """Relations with ``<side>_ok``: the end is an accepted entity of the chunk by any of three keys (three semi-joins' worth in one)."""
    text, name = status(f"{side}_entity_text"), F.coalesce(F.nullif(status(f"{side}_normalized_name"), F.lit("")), status(f"{side}_entity_text"))
    kind = F.lower(status(f"{side}_entity_type"))
    tried = F.filter(F.array(F.when(status(f"{side}_entity_id") != "", F.concat(F.lit("id:"), status(f"{side}_entity_id"))), F.concat(F.lit("t:"), kind, F.lit("|"), F.lower(text)), F.concat(F.lit("n:"), kind, F.lit("|"), F.lower(name))), lambda x: x.isNotNull())
    each = relations.select("row_number", status("chunk_id").alias("c"), F.explode(tried).alias("k"))
    hit = each.join(keys, (F.col("c") == F.col("_chunk")) & (F.col("k") == F.col("_k")), "left_semi").select(F.col("row_number").alias("_r")).distinct().withColumn(f"{side}_ok", F.lit(True))
    return relations.join(hit, F.col("row_number") == F.col("_r"), "left").drop("_r").withColumn(f"{side}_ok", F.coalesce(f"{side}_ok", F.lit(False)))


def issues(chunks: DataFrame, entities: DataFrame, relations: DataFrame, entity_types: list[str] | None = None, relation_types: list[str] | None = None) -> DataFrame:
    """(sheet, row_number, chunk_id, field, message): every check that a row fails."""
    entity_types, relation_types = entity_types or dims.ENTITY_TYPES, relation_types or list(dims.DIRECTIONS)
    cid = status("chunk_id")
    first = chunks.where(cid != "").groupBy(cid.alias("_id")).agg(F.min("row_number").alias("_first"), F.max_by(F.struct("chunk_text", "start_char"), "row_number").alias("_c"))
    c = chunks.join(first, cid == F.col("_id"), "left")
    out = _issues(c, {"chunk_missing": cid == "", "chunk_duplicate": (cid != "") & (F.col("row_number") > F.col("_first")), "chunk_open": (cid != "") & unresolved()})
    known = first.select("_id", "_c")

    def supported() -> Column:
        return T.evidence_supported(status("evidence_text"), T.clean(F.col("_c.chunk_text")), F.col("evidence_start_char").cast("string"), F.col("evidence_end_char").cast("string"), F.col("_c.start_char").cast("string"))

    e, ok = entities.join(known, cid == F.col("_id"), "left"), entity_accepted()
    out = out.unionByName(_issues(e, {"entity_open": unresolved(), "entity_type": ok & ~status("entity_type").isin(entity_types), "entity_text": ok & (status("entity_text") == ""), "entity_chunk": ok & F.col("_id").isNull(), "entity_evidence": ok & F.col("_id").isNotNull() & ~supported()}))
    keys = accepted_endpoints(entities)
    r = with_endpoint(with_endpoint(relations, keys, "source"), keys, "target").join(known, cid == F.col("_id"), "left")
    open_ = unresolved() | status("annotation_decision").isin("", "needs_review")
    ok = ~open_ & relation_accepted()
    return out.unionByName(
        _issues(
            r,
            {
                "relation_open": open_, "relation_type": ok & ~status("relationship_type").isin(relation_types), "relation_chunk": ok & F.col("_id").isNull(), "relation_evidence": ok & F.col("_id").isNotNull() & ~supported(),
                "relation_direction": ok & (status("direction_verified") != "yes"), "relation_negated": ok & (status("negated") != "no"), "relation_speculative": ok & (status("speculative") != "no"),
                "relation_implied": ok & (status("explicit_or_implied") == "weak_implication"), "relation_source": ok & ~F.col("source_ok"), "relation_target": ok & ~F.col("target_ok"),
            },
        )
    )


def summary(documents: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Ten counts in one row; each table is read once."""
    open_ = unresolved() | status("annotation_decision").isin("", "needs_review")
    each = [
        documents.agg(F.count("*").alias("document_count")),
        chunks.agg(F.count("*").alias("chunk_count")),
        entities.agg(F.count("*").alias("entity_rows"), F.count_if(entity_accepted()).alias("accepted_entities"), F.count_if(status("annotation_status") == "rejected").alias("rejected_entities"), F.count_if(unresolved()).alias("unresolved_entities")),
        relations.agg(F.count("*").alias("relationship_rows"), F.count_if(relation_accepted()).alias("accepted_relationships"), F.count_if((status("annotation_status") == "rejected") | (status("annotation_decision") == "exclude")).alias("rejected_relationships"), F.count_if(open_).alias("unresolved_relationships")),
    ]
    rows = each[0]
    for r in each[1:]:
        rows = rows.unionByName(r, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def coverage(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, problem): ids that a response lacks or has too many; empty if it covers exactly the expected ones."""
    e, o = expected.select(key).distinct(), observed.select(key).distinct()
    return e.join(o, key, "left_anti").select(key, F.lit("missing").alias("problem")).unionByName(o.join(e, key, "left_anti").select(key, F.lit("extra").alias("problem")))


def reviewed(rows: DataFrame, reviews: DataFrame, key: str, fields: list[str], accept: list[str]) -> DataFrame:
    """Rows with the decisions of a review: accepted rows take its non-empty fields, the others are rejected; rows without a review stay."""
    r = reviews.select(F.col(key).alias("_k"), F.col("decision").alias("_d"), F.col("reason").alias("_why"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = rows.join(r, F.col(key) == F.col("_k"), "left")
    yes = F.col("_d").isin(accept)
    new = {f: F.when(yes, F.coalesce(F.nullif(T.clean(F.col(f"_{f}")), F.lit("")), F.col(f))).otherwise(F.col(f)) for f in fields}
    new |= {"annotation_status": F.when(F.col("_d").isNull(), F.col("annotation_status")).when(yes, "accepted").otherwise("rejected"), "notes": F.when(F.col("_d").isNotNull(), F.concat(F.lit("review="), "_d", F.lit("; reason="), T.clean(F.col("_why")))).otherwise(F.col("notes") if "notes" in rows.columns else F.lit(""))}
    return out.withColumns(new).drop("_k", "_d", "_why", *[f"_{f}" for f in fields])


def added(rows: DataFrame, additions: DataFrame) -> DataFrame:
    """Rows and the additions of a review; columns that an addition lacks are null."""
    return rows.unionByName(additions, allowMissingColumns=True)


def gold(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted rows of both sheets."""
    return entities.where(entity_accepted()), relations.where(relation_accepted())


def adjudicated(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Gold rows if no check fails, else none; and the issues."""
    found = issues(chunks, entities, relations)
    return (*(gold(entities, relations) if found.isEmpty() else (None, None)), found)


def silver(chunks: DataFrame, mentions: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Draft entity rows for review: mentions placed in their chunk (offsets of the document), open for decision."""
    c = chunks.select(F.col(key).alias("_k"), "text", "start_char")
    out = mentions.join(c, F.col(key) == F.col("_k"), "left")
    at = T.span_of(F.col("name"), F.col("text"), F.col("start_char"))
    return out.select(key, T.key_of("silver_entity:", F.col(key), F.col("type"), F.col("name"), cut=16).alias("entity_gold_id"), F.col("type").alias("entity_type"), F.col("name").alias("entity_text"), at["start"].alias("start_char"), at["end"].alias("end_char"), F.lit("needs_review").alias("annotation_status"))
