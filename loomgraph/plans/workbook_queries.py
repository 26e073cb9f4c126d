"""Queries over the silver workbook (documents as processed records, a line as a chunk, a lexicon as the extractor) and over model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import models, plugins, workbook
from .tables import table
from .text_queries import LEXICON, LEXICON_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as processed records: lines with a word are chunks; the lexicon's names in a line are its entities, drugs and
    conditions of a line relationships, drugs and biomarkers rejected ones, risk factors rejected as loose words."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("k"), "lang", "source", F.split("text", "\n").alias("lines"))
    end = "struct<id:string,type:string,name:string>"
    lexicon = F.array(*[F.struct(T.entity_id(F.lit(t), F.lit(a)).alias("id"), F.lit(t).alias("type"), F.lit(a).alias("name")) for t, _, a in LEXICON]).cast(f"array<{end}>")
    starts = F.transform(T.sums_before(F.transform("lines", lambda x: F.length(x) + 1)), lambda n: n.cast("int"))
    chunk = lambda x, i: F.struct(F.concat_ws("-", F.concat(F.lit("C"), "k"), i).alias("id"), F.lit(None).cast("string").alias("document_id"), i.alias("order"), F.when(i == 0, "title").otherwise("body").alias("section"), x.alias("text"), F.get("starts", i).alias("char_start"), (F.get("starts", i) + F.length(x)).alias("char_end"))
    d = d.withColumn("starts", starts).withColumn("chunks", F.filter(F.transform("lines", chunk), lambda c: F.btrim(c["text"], F.lit(T.BLANKS)) != ""))
    props = "struct<aliases:string,category:string,mesh_id:string,icd10:string,drugbank_id:string,unit:string,normal_range:string,description:string>"

    def extraction(c):  # noqa: ANN001, ANN202
        met = T.bound(F.lower(c["text"]), lambda low: F.filter(lexicon, lambda x: F.contains(low, x["name"])))
        return T.bound(met, lambda own: drafted(c, own))

    def drafted(c, met):  # noqa: ANN001, ANN202
        of = lambda kind: F.filter(met, lambda x: x["type"] == kind)
        i = c["order"]
        said = F.when(i % 5 == 4, "").when(i % 5 == 3, F.concat(F.lit("unstated "), F.substring(c["text"], 3, 40))).otherwise(F.substring(c["text"], 3, 40))
        alias = lambda x: F.named_struct(F.lit("aliases"), F.to_json(F.array(x["name"], x["id"])), *[y for n in ("category", "mesh_id", "icd10", "drugbank_id", "unit", "normal_range", "description") for y in (F.lit(n), F.lit(None).cast("string"))]).cast(props)
        pair = lambda a, b: F.struct(F.concat_ws("-", a["id"], b["id"]).alias("id"), F.lit("TREATS").alias("type"), a.alias("source"), b.alias("target"), F.struct(F.lit("0.8").alias("confidence"), said.alias("evidence")).alias("properties"))
        wrong = lambda a, b: F.to_json(F.struct(F.concat_ws(" TREATS ", a["name"], b["name"]).alias("text"), F.lit("relationship direction is invalid for the ontology").alias("reason")))
        each = lambda xs, ys, make: F.flatten(F.transform(xs, lambda a: F.transform(ys, lambda b: make(a, b))))
        return F.struct(
            c["id"].alias("chunk_id"),
            F.when(i % 2 == 0, F.array(F.concat(F.lit("calls/"), c["id"]))).alias("model_call_paths"),
            F.transform(met, lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["name"].alias("name"), alias(x).alias("properties"))).alias("entities"),
            each(of("Drug"), of("Condition"), pair).alias("relationships"),
            F.concat(each(of("Drug"), of("Biomarker"), wrong), F.transform(of("RiskFactor"), lambda x: x["name"])).alias("rejected_candidates"),
        )

    none = F.lit(None).cast("string")
    document = F.struct(F.concat(F.lit("doc:"), "k").alias("id"), none.alias("pmid"), F.concat(F.lit("PMC"), "k").alias("pmcid"), F.col("lang").alias("title"), F.lit("2020").alias("year"), F.col("source").alias("journal"), none.alias("doi"), F.to_json(F.array(F.coalesce("lang", F.lit("")), F.lit("x y"))).alias("authors"), none.alias("abstract"), none.alias("source_url"), none.alias("ingested_at"))
    run = F.struct(F.lit("local").alias("model_profile"), F.lit("").alias("extractor_provider"), F.lit("lexicon").alias("extractor_model"))
    return d.select(document.alias("document"), run.alias("run"), "chunks", F.transform("chunks", extraction).alias("extractions"))


def _sql_cells(name: str, **values: str) -> str:
    return "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({values[h]} AS VARCHAR), '')" if h in values else "''" for h in workbook.HEADERS[name]) + ")"


_WHO = "'local / lexicon'"
_CHUNK = {"document_id": "did", "chunk_id": "cid", "pmcid": "pmcid", "annotator": _WHO}
_DRAFT = _CHUNK | {"evidence_section": "section", "notes": "note", "annotation_status": "'needs_review'"}
_SPAN = {"evidence_text": "CASE WHEN place > 0 THEN substring(line, place, length(needle)) ELSE needle END", "evidence_start_char": "CASE WHEN place > 0 THEN start + place - 1 END", "evidence_end_char": "CASE WHEN place > 0 THEN start + place - 1 + length(needle) END"}


def _gold(prefix: str, *parts: str) -> str:
    return f"'{prefix}:' || substring(sha1(concat_ws('|', {', '.join(parts)})), 1, 16)"


_DOC_CELLS = _sql_cells("documents", document_id="did", pmcid="pmcid", title="lang", year="'2020'", journal="source", authors="coalesce(lang, '') || '; x y'", included_in_extraction_gold="'yes'", included_in_qa_eval="'yes'", notes=f"'{workbook.DOCUMENT_NOTE}'")
_CHUNK_CELLS = _sql_cells("chunks", **_CHUNK, chunk_index="ord", chunk_section="section", chunk_text="line", start_char="start", end_char="start + length(line)", included_in_gold_annotation="'yes'", annotation_status="'needs_review'", notes=f"'{workbook.CHUNK_NOTE}'")
_ENTITY_CELLS = _sql_cells("gold_entities", **_DRAFT, **_SPAN, entity_gold_id=_gold("silver_entity", "did", "cid", "eid", "needle"), entity_id="eid", entity_type="type", entity_text="needle", normalized_name="needle", aliases="needle || '; ' || eid")
_RELATION_CELLS = _sql_cells(
    "gold_relationships", **_DRAFT, **_SPAN, relationship_gold_id=_gold("silver_relationship", "did", "cid", "a_id || '-' || b_id", "'TREATS'", "a_id", "b_id"), relationship_type="'TREATS'", source_entity_id="a_id", source_entity_type="'Drug'", source_entity_text="a", source_normalized_name="a",
    target_entity_id="b_id", target_entity_type="'Condition'", target_entity_text="b", target_normalized_name="b", confidence_gold="'0.8'", direction_verified="'needs_review'", explicit_or_implied="CASE WHEN needle <> '' THEN 'explicit' END", negated="'unclear'", speculative="'unclear'", annotation_decision="'needs_review'",
)
_REJECTED_CELLS = _sql_cells("rejected_candidates", **_CHUNK, notes="note", rejected_id=_gold("silver_rejected", "did", "cid", "said", "why"), candidate_text="said", candidate_type="kind", reason="why", annotation_rule="why")

SILVER_SQL = f"""WITH {LEXICON_SQL},
lex2 AS (SELECT type, alias AS name, lower(type) || ':' || trim(regexp_replace(lower(alias), '[^a-z0-9]+', '_', 'g'), '_') AS eid FROM lex),
d AS (SELECT 'doc:' || doc_id AS did, 'PMC' || doc_id AS pmcid, doc_id, lang, source, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT did, pmcid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS ord FROM d),
c AS (SELECT did, pmcid, 'C' || doc_id || '-' || ord AS cid, ord, line, CASE WHEN ord = 0 THEN 'title' ELSE 'body' END AS section, CASE WHEN ord % 2 = 0 THEN '{workbook.ROW_NOTE}; audit=calls/C' || doc_id || '-' || ord ELSE '{workbook.ROW_NOTE}' END AS note,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY did ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
k AS (SELECT * FROM c WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
e AS (SELECT k.*, type, eid, name AS needle, instr(lower(line), name) AS place FROM k JOIN lex2 ON contains(lower(line), name)),
p AS (SELECT a.* EXCLUDE (type, eid, needle, place), a.needle AS a, a.eid AS a_id, b.needle AS b, b.eid AS b_id, b.type AS b_type FROM e a JOIN e b USING (cid) WHERE a.type = 'Drug' AND b.type IN ('Condition', 'Biomarker')),
r AS (SELECT *, CASE ord % 5 WHEN 4 THEN '' WHEN 3 THEN 'unstated ' || substring(line, 3, 40) ELSE substring(line, 3, 40) END AS needle FROM p WHERE b_type = 'Condition'),
s AS (SELECT *, CASE WHEN needle = '' THEN 0 ELSE instr(lower(line), lower(needle)) END AS place FROM r),
x AS (SELECT did, pmcid, cid, note, a || ' TREATS ' || b AS said, 'relationship direction is invalid for the ontology' AS why, 'relationship' AS kind FROM p WHERE b_type = 'Biomarker'
  UNION ALL SELECT did, pmcid, cid, note, needle, '{workbook.NOT_AN_OBJECT}', 'other' FROM e WHERE type = 'RiskFactor'),
o AS (SELECT 'documents' AS sheet, did AS document_id, {_DOC_CELLS} AS cells FROM d
  UNION ALL SELECT 'chunks', did, {_CHUNK_CELLS} FROM k
  UNION ALL SELECT 'gold_entities', did, {_ENTITY_CELLS} FROM e
  UNION ALL SELECT 'gold_relationships', did, {_RELATION_CELLS} FROM s
  UNION ALL SELECT 'rejected_candidates', did, {_REJECTED_CELLS} FROM x)
SELECT sheet, document_id, string_split(cells, chr(31))[1] AS row_id, sha256(cells) AS cells_sha256 FROM o"""


def silver_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the five drafted sheets; a digest stands for its cells."""
    made = workbook.rows(records(spark, sf_dir))
    return made.select("sheet", "document_id", F.get("cells", F.lit(0)).alias("row_id"), F.sha2(F.array_join("cells", "\x1f"), 256).alias("cells_sha256"))


QUERIES["silver_sheets"] = silver_sheets
ORACLE["silver_sheets"] = SILVER_SQL


def model_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit row for each turn as a prompt: the offline model, in pools of calls; blank turns are errors without a call."""
    turns = table(spark, sf_dir, "conversations")
    text = F.when(F.btrim(F.coalesce("text", F.lit("")), F.lit(T.BLANKS)) != "", plugins.prompt("Turn {turn} of {role}: {text}", turn=F.col("turn"), role=F.col("role"), text=F.col("text")))
    prompts = turns.select("conv_id", "turn", F.sha2(text, 256).alias("prompt_sha256"), text.alias("prompt"))
    return models.calls(prompts, models.noop, ["conv_id", "turn", "prompt_sha256"], as_object=True).select("conv_id", "turn", "prompt_sha256", "answer", "status", "error", "tries")


QUERIES["model_audit"] = model_audit
ORACLE["model_audit"] = """WITH p AS (SELECT conv_id, turn, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' THEN 'Turn ' || turn || ' of ' || coalesce(role, '') || ': ' || text END AS prompt FROM conversations)
SELECT conv_id, turn, sha256(prompt) AS prompt_sha256, CASE WHEN prompt IS NOT NULL THEN '{}' END AS answer, CASE WHEN prompt IS NULL THEN 'error' ELSE 'ok' END AS status, CASE WHEN prompt IS NULL THEN 'no prompt' ELSE '' END AS error, CASE WHEN prompt IS NULL THEN 0 ELSE 1 END AS tries FROM p"""
