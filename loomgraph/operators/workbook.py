"""The silver workbook: processed records as the sheets that reviewers open.

A record is one nested row of ``RECORD``: a document, its run, its chunks and what was extracted from each.  ``rows`` makes the
rows of five sheets in one scan without a shuffle: a record falls into its document, its chunks and its extractions, each of these
into the rows of its sheets, and evidence is placed in the chunk after that, so that no more than a chunk is copied for a row.
``sheet`` is one of them as a table in the workbook's order, ``written`` the whole workbook as a folder of CSV sheets.

Defined cases: a missing text is ""; a missing list is empty and missing entries of it do not count; of chunks with equal ids an
extraction belongs to the last; an extraction of no known chunk has no section, and its evidence no place; evidence that the chunk does
not hold keeps its text and has no place; ties keep the order they came in; repeated records give repeated rows; a record without a
document gives a documents row without id; records may have more columns, which do not count, but for ``path``, the file they come from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from ..shared import kept
from ..sources import sinks

_END = "struct<id string, type string, name string>"
_ENTITY = "struct<id string, type string, name string, properties struct<aliases string, category string, mesh_id string, icd10 string, drugbank_id string, unit string, normal_range string, description string>>"
_RELATION = f"struct<id string, type string, source {_END}, target {_END}, properties struct<confidence string, evidence string>>"
#: A processed record; lists or objects in a field of text are their JSON text, as Spark's reader gives it.
RECORD = f"""document struct<id string, pmid string, pmcid string, title string, year string, journal string, doi string, authors string, abstract string, source_url string, ingested_at string>,
run struct<model_profile string, extractor_provider string, extractor_model string>,
chunks array<struct<id string, document_id string, order int, section string, text string, char_start int, char_end int>>,
extractions array<struct<chunk_id string, model_call_paths array<string>, entities array<{_ENTITY}>, relationships array<{_RELATION}>, rejected_candidates array<string>>>"""

#: The sheets and their columns.
HEADERS = {
    "documents": ["document_id", "pmid", "pmcid", "title", "year", "journal", "doi", "authors", "abstract", "topic_tags", "included_in_extraction_gold", "included_in_qa_eval", "source_file_path", "source_url", "download_date", "notes"],
    "chunks": ["chunk_id", "document_id", "pmid", "pmcid", "chunk_index", "chunk_section", "chunk_text", "start_char", "end_char", "included_in_gold_annotation", "annotator", "annotation_status", "notes"],
    "gold_entities": ["entity_gold_id", "document_id", "chunk_id", "pmid", "pmcid", "entity_id", "entity_type", "entity_text", "normalized_name", "aliases", "category", "mesh_id", "icd10", "drugbank_id", "unit", "normal_range", "description", "evidence_text", "evidence_section", "evidence_start_char", "evidence_end_char", "annotator", "annotation_status", "notes"],
    "gold_relationships": ["relationship_gold_id", "document_id", "chunk_id", "pmid", "pmcid", "relationship_type", "source_entity_id", "source_entity_type", "source_entity_text", "source_normalized_name", "target_entity_id", "target_entity_type", "target_entity_text", "target_normalized_name", "evidence_text", "evidence_section", "evidence_start_char", "evidence_end_char", "confidence_gold", "direction_verified", "explicit_or_implied", "negated", "speculative", "annotation_decision", "annotator", "annotation_status", "notes"],
    "rejected_candidates": ["rejected_id", "document_id", "chunk_id", "pmid", "pmcid", "candidate_text", "candidate_type", "candidate_relationship_type", "source_candidate", "target_candidate", "reason", "evidence_text", "annotation_rule", "annotator", "notes"],
    "annotation_notes": ["note_id", "document_id", "chunk_id", "related_entity_gold_id", "related_relationship_gold_id", "issue_type", "question", "decision", "rationale", "annotator", "created_at"],
}
#: What a cell may hold, by list, and the columns that each list governs.
ALLOWED = {
    "entity_type": dims.NODE_LABELS,
    "relationship_type": list(dims.DIRECTIONS),
    "annotation_status": ["draft", "needs_review", "accepted", "rejected", "reviewed"],
    "annotation_decision": ["include", "exclude", "needs_review"],
    "yes_no_unclear": ["yes", "no", "unclear"],
    "direction_verified": ["yes", "no", "needs_review"],
    "explicit_or_implied": ["explicit", "strong_implication", "weak_implication"],
    "candidate_type": ["entity", "relationship", "other"],
    "issue_type": ["alias_normalization", "relationship_ambiguity", "directionality_issue", "ontology_gap", "evidence_unclear", "duplicate_entity", "other"],
    "boolean_yes_no": ["yes", "no"],
}
GOVERNED = {
    "documents": {"included_in_extraction_gold": "boolean_yes_no", "included_in_qa_eval": "boolean_yes_no"},
    "chunks": {"included_in_gold_annotation": "boolean_yes_no", "annotation_status": "annotation_status"},
    "gold_entities": {"entity_type": "entity_type", "annotation_status": "annotation_status"},
    "gold_relationships": {
        "source_entity_type": "entity_type", "target_entity_type": "entity_type", "relationship_type": "relationship_type", "direction_verified": "direction_verified", "explicit_or_implied": "explicit_or_implied",
        "negated": "yes_no_unclear", "speculative": "yes_no_unclear", "annotation_decision": "annotation_decision", "annotation_status": "annotation_status",
    },
    "rejected_candidates": {"candidate_type": "candidate_type", "candidate_relationship_type": "relationship_type"},
    "annotation_notes": {"issue_type": "issue_type"},
}
#: Notes and marks of drafted rows.
DOCUMENT_NOTE, CHUNK_NOTE, ROW_NOTE = "silver bootstrap source document", "silver bootstrap chunk", "silver bootstrap"
NOT_AN_OBJECT = "rejected candidate is not an object"
OPEN = "needs_review"

EVIDENCE = ("evidence_text", "evidence_start_char", "evidence_end_char")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _listed(c: Column) -> Column:
    """A field that may be the JSON text of a list (its entries joined by "; ") or of an object (its keys sorted), or plain text."""
    entries = F.from_json(c, "array<string>")
    fields = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))))
    return F.coalesce(F.when(F.startswith(c, F.lit("[")), F.array_join(entries, "; ", "")).when(F.startswith(c, F.lit("{")), fields), c, F.lit(""))


def _some(c: Column) -> Column:
    return F.filter(F.coalesce(c, F.array()), lambda x: x.isNotNull())


def _by(items: Column, *keys: Callable[[Column], Column]) -> Column:
    """The entries of an array by keys; ties in the order they had."""
    places = lambda xs: F.array_sort(F.transform(xs, lambda x, i: F.struct(*[k(x).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"))))
    return T.bound(items, lambda xs: F.transform(places(xs), lambda p: F.get(xs, p["i"])))


def _cells(name: str, **values: Column | str) -> Column:
    """All cells of a row of a sheet in the order of its columns."""
    return F.array(*[_text(v) if isinstance(v := values.get(h, ""), Column) else F.lit(v) for h in HEADERS[name]])


def _item(name: str, cells: Column, needle: Column | None = None) -> Column:
    return F.struct(F.lit(name).alias("sheet"), (_text(needle) if needle is not None else F.lit("")).alias("needle"), cells.alias("cells"))


def _parts(records: DataFrame) -> DataFrame:
    """(path, key, pmid, pmcid, annotator, p, document, chunk, extraction): a row for each document, chunk and extraction, in order;
    an extraction comes with its chunk (J20), found by position in the list of ids."""
    path = F.col("path") if "path" in records.columns else F.lit("")
    own = records.select(path.alias("path"), "document", "run", _by(_some(F.col("chunks")), lambda c: F.coalesce(c["order"], F.lit(0))).alias("_sorted"), _some(F.col("chunks")).alias("_chunks"), _some(F.col("extractions")).alias("_found"))
    backwards = F.reverse(F.transform("_chunks", lambda c: _text(c["id"])))
    chunk_of = lambda e, ids: F.try_element_at("_chunks", F.nullif(-F.array_position(ids, _text(e["chunk_id"])), F.lit(0)).cast("int"))
    own = own.withColumn("_met", T.bound(backwards, lambda ids: F.transform("_found", lambda e: F.struct(chunk_of(e, ids).alias("chunk"), e.alias("extraction")))))
    met = _by(F.col("_met"), lambda m: F.coalesce(m["chunk"]["order"], F.lit(0)), lambda m: _text(m["extraction"]["chunk_id"]))
    kind = {f.name: f.dataType for f in own.schema}
    none = {"document": F.lit(None).cast(kind["document"]), "chunk": F.lit(None).cast(kind["_chunks"].elementType), "extraction": F.lit(None).cast(kind["_found"].elementType)}
    part = lambda **given: F.struct(*[given.get(k, v).alias(k) for k, v in none.items()])
    each = F.concat(F.array(part(document=F.col("document"))), F.transform("_sorted", lambda c: part(chunk=c)), F.transform(met, lambda m: part(chunk=m["chunk"], extraction=m["extraction"])))
    names = [F.nullif(F.col(f"run.{n}"), F.lit("")) for n in ("model_profile", "extractor_provider", "extractor_model")]
    return own.select("path", F.col("document.id").alias("key"), _text(F.col("document.pmid")).alias("pmid"), _text(F.col("document.pmcid")).alias("pmcid"), F.concat_ws(" / ", *names).alias("annotator"), F.posexplode(each).alias("p", "part")).select("*", "part.*").drop("part")


def rows(records: DataFrame) -> DataFrame:
    """(sheet, document_id, pmcid, path, p, q, cells): every row of the five sheets that records fill; (pmcid, path, p, q) is their order."""
    key, pmid, pmcid, who = (F.col(c) for c in ("key", "pmid", "pmcid", "annotator"))
    d, c, e = F.col("document"), F.col("chunk"), F.col("extraction")
    place = {"document_id": key, "chunk_id": e["chunk_id"], "pmid": pmid, "pmcid": pmcid, "annotator": who}
    calls = F.array_join(e["model_call_paths"], ";", "")
    place["notes"] = F.when(F.size(F.coalesce(e["model_call_paths"], F.array())) > 0, F.concat(F.lit(f"{ROW_NOTE}; audit="), calls)).otherwise(ROW_NOTE)
    document = _item(
        "documents",
        _cells(
            "documents", document_id=key, pmid=pmid, pmcid=pmcid, title=d["title"], year=d["year"], journal=d["journal"], doi=d["doi"], authors=_listed(d["authors"]), abstract=d["abstract"],
            included_in_extraction_gold="yes", included_in_qa_eval="yes", source_file_path=F.col("path"), source_url=d["source_url"], download_date=d["ingested_at"], notes=DOCUMENT_NOTE,
        ),
    )
    chunk = _item(
        "chunks",
        _cells(
            "chunks", chunk_id=c["id"], document_id=T.first_of(c["document_id"], key), pmid=pmid, pmcid=pmcid, chunk_index=c["order"], chunk_section=c["section"], chunk_text=c["text"], start_char=c["char_start"], end_char=c["char_end"],
            included_in_gold_annotation="yes", annotator=who, annotation_status=OPEN, notes=CHUNK_NOTE,
        ),
    )

    def entity(x: Column) -> Column:
        props = {h: _listed(x["properties"][h]) if h == "aliases" else x["properties"][h] for h in ("aliases", "category", "mesh_id", "icd10", "drugbank_id", "unit", "normal_range", "description")}
        gold = T.key_of("silver_entity:", key, e["chunk_id"], x["id"], x["name"], cut=16)
        return _item("gold_entities", _cells("gold_entities", entity_gold_id=gold, entity_id=x["id"], entity_type=x["type"], entity_text=x["name"], normalized_name=x["name"], evidence_section=c["section"], annotation_status=OPEN, **props, **place), x["name"])

    def relation(x: Column) -> Column:
        gold = T.key_of("silver_relationship:", key, e["chunk_id"], x["id"], x["type"], x["source"]["id"], x["target"]["id"], cut=16)
        ends = {f"{end}_{name}": x[end][field] for end in ("source", "target") for name, field in (("entity_id", "id"), ("entity_type", "type"), ("entity_text", "name"), ("normalized_name", "name"))}
        said = _text(x["properties"]["evidence"])
        cells = _cells(
            "gold_relationships", relationship_gold_id=gold, relationship_type=x["type"], evidence_section=c["section"], confidence_gold=x["properties"]["confidence"], direction_verified=OPEN,
            explicit_or_implied=F.when(said != "", "explicit"), negated="unclear", speculative="unclear", annotation_decision=OPEN, annotation_status=OPEN, **ends, **place,
        )
        return _item("gold_relationships", cells, said)

    def rejected(x: Column) -> Column:
        whole = F.startswith(x, F.lit("{"))
        text = F.when(whole, _text(F.get_json_object(x, "$.text"))).otherwise(x)
        why = F.when(whole, _text(F.get_json_object(x, "$.reason"))).otherwise(NOT_AN_OBJECT)
        gold = T.key_of("silver_rejected:", key, e["chunk_id"], text, why, cut=16)
        return _item("rejected_candidates", _cells("rejected_candidates", rejected_id=gold, candidate_text=text, candidate_type=T.evidence_kind(why, text), reason=why, annotation_rule=why, **place))

    found = F.concat(
        F.transform(_by(_some(e["entities"]), lambda x: _text(x["type"]), lambda x: _text(x["name"]), lambda x: _text(x["id"])), entity),
        F.transform(_by(_some(e["relationships"]), lambda x: _text(x["id"])), relation),
        F.transform(_some(e["rejected_candidates"]), rejected),
    )
    items = F.when(F.col("p") == 0, F.array(document)).when(e.isNull(), F.array(chunk)).otherwise(found)
    each = _parts(records).select(_text(key).alias("document_id"), "pmcid", "path", "p", _text(c["text"]).alias("_text"), F.coalesce(c["char_start"], F.lit(0)).alias("_base"), F.posexplode(items).alias("q", "x"))
    placed = F.col("x.sheet").isin("gold_entities", "gold_relationships")
    each = each.withColumn("_span", F.when(placed & (F.col("_text") != ""), T.span_of(F.col("x.needle"), F.col("_text"), F.col("_base"))))
    start, end = F.col("_span.start"), F.col("_span.end")
    said = F.when(F.col("_span").isNotNull(), F.substr(F.col("_text"), start - F.col("_base") + 1, end - start)).otherwise(F.col("x.needle"))
    cells = F.col("x.cells")
    for name in ("gold_entities", "gold_relationships"):
        at, own = {h: n for n, h in enumerate(HEADERS[name])}, dict(zip(EVIDENCE, (said, _text(start), _text(end)), strict=True))
        filled = F.array(*[own[h] if h in own else F.get(F.col("x.cells"), F.lit(n)) for h, n in at.items()])
        cells = F.when(F.col("x.sheet") == name, filled).otherwise(cells)
    return each.select("x.sheet", "document_id", "pmcid", "path", "p", "q", cells.alias("cells"))


def sheet(made: DataFrame, name: str) -> DataFrame:
    """One sheet of ``rows``, its columns by name, in the workbook's order."""
    own = made.where(F.col("sheet") == name).orderBy("pmcid", "path", "p", "q")
    return own.select(*[F.get("cells", F.lit(n)).alias(h) for n, h in enumerate(HEADERS[name])])


def allowed_values(spark: SparkSession) -> DataFrame:
    """The sheet of lists: a column for each, shorter ones filled with ""."""
    most = max(len(v) for v in ALLOWED.values())
    return spark.createDataFrame([tuple(v[k] if k < len(v) else "" for v in ALLOWED.values()) for k in range(most)], list(ALLOWED))


def violations(sheets: dict[str, DataFrame]) -> DataFrame:
    """(sheet, row_id, field, value): cells that hold a value which their column's list lacks; empty cells are allowed."""
    out = None
    for name, own in sheets.items():
        tests = [F.when((_text(F.col(f)) != "") & ~_text(F.col(f)).isin(ALLOWED[kind]), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"))) for f, kind in GOVERNED.get(name, {}).items()]
        if tests:
            bad = own.select(F.lit(name).alias("sheet"), F.col(HEADERS[name][0]).alias("row_id"), F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("x")).select("sheet", "row_id", "x.*")
            out = bad if out is None else out.unionByName(bad)
    if out is None:
        raise ValueError("no sheet has governed columns")
    return out


def written(records: DataFrame, folder: str) -> None:
    """The workbook of the records as a folder of CSV sheets; the records are read once."""
    spark, made = records.sparkSession, kept(rows(records))
    sheets = {name: sheet(made, name) for name in HEADERS if name != "annotation_notes"}
    sheets["annotation_notes"] = spark.createDataFrame([], ", ".join(f"{h} string" for h in HEADERS["annotation_notes"]))
    sheets["allowed_values"] = allowed_values(spark)
    sinks.write_sheets(sheets, folder)
