"""The silver workbook against a plain restatement, its odd cases, and the round trip through a folder of sheets."""

import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import workbook
from loomgraph.sources import readers

RECORDS = [
    {
        "document": {"id": "doc:2", "pmid": "7", "pmcid": "PMC2", "title": 'A "quoted" title', "year": 2020, "authors": ["Ann A", "Bo B"], "abstract": "one,\ntwo"},
        "run": {"model_profile": "local", "extractor_provider": "", "extractor_model": "m1"},
        "chunks": [
            {"id": "c2", "order": 2, "section": "body", "text": "Straße and İstanbul: FISH OIL helps.", "char_start": 100, "char_end": 136},
            {"id": "c1", "order": 1, "section": "intro", "text": " aspirin treats pain ", "char_start": 0, "char_end": 21, "document_id": "doc:x"},
        ],
        "extractions": [
            {"chunk_id": "c2", "entities": [{"id": "drug:fish_oil", "type": "Drug", "name": "fish oil", "properties": {"aliases": ["omega", "EPA"], "unit": "g"}}, {"id": "drug:fish_oil", "type": "Condition", "name": "STRASSE"}, None], "relationships": []},
            {
                "chunk_id": "c1", "model_call_paths": ["a.json", "b.json"], "entities": [{"id": "e2", "type": "Drug", "name": "absent"}],
                "relationships": [
                    {"id": "r2", "type": "TREATS", "source": {"id": "s", "type": "Drug", "name": "aspirin"}, "target": {"id": "t", "type": "Condition", "name": "pain"}, "properties": {"confidence": 0.9, "evidence": "Aspirin Treats"}},
                    {"id": "r1", "type": "CURES", "source": None, "properties": None},
                ],
                "rejected_candidates": [{"text": "pain TREATS aspirin", "reason": "relationship direction is invalid"}, "loose words", {"reason": "entity is unknown"}],
            },
            {"chunk_id": "gone", "entities": [{"id": "e9", "type": "Drug", "name": "aspirin"}]},
        ],
        "path": "two.json",
    },
    {"document": {"id": "doc:1", "pmcid": "PMC1"}, "chunks": None, "extractions": None, "path": "one.json", "extra": 1},
    {"document": None, "path": "none.json"},
]


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("records")
    for k, r in enumerate(RECORDS):
        (folder / f"{k}.json").write_text(json.dumps(r))
    return spark.read.schema(workbook.RECORD + ", path string").option("multiLine", True).json(str(folder))


def listed(df):
    return [r.asDict() for r in df.collect()]


def key(prefix, *parts):
    return f"{prefix}:" + hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def test_documents_and_chunks(records):
    made = workbook.rows(records)
    docs = listed(workbook.sheet(made, "documents"))
    assert [(d["document_id"], d["pmcid"], d["source_file_path"]) for d in docs] == [("", "", "none.json"), ("doc:1", "PMC1", "one.json"), ("doc:2", "PMC2", "two.json")]
    assert (docs[2]["authors"], docs[2]["year"], docs[2]["topic_tags"], docs[2]["notes"]) == ("Ann A; Bo B", "2020", "", "silver bootstrap source document")
    chunks = listed(workbook.sheet(made, "chunks"))
    assert [(c["chunk_id"], c["document_id"], c["chunk_index"], c["start_char"], c["annotator"]) for c in chunks] == [("c1", "doc:x", "1", "0", "local / m1"), ("c2", "doc:2", "2", "100", "local / m1")]


def test_entities_are_placed_in_their_source_text(records):
    got = listed(workbook.sheet(workbook.rows(records), "gold_entities"))
    # an extraction without a known chunk counts as of place 0, so it comes first
    assert [(e["chunk_id"], e["entity_text"], e["evidence_text"], e["evidence_start_char"], e["evidence_end_char"]) for e in got] == [
        ("gone", "aspirin", "aspirin", "", ""), ("c1", "absent", "absent", "", ""), ("c2", "STRASSE", "Straße", "100", "106"), ("c2", "fish oil", "FISH OIL", "121", "129")]
    assert got[3]["entity_gold_id"] == key("silver_entity", "doc:2", "c2", "drug:fish_oil", "fish oil")
    assert (got[3]["aliases"], got[3]["unit"], got[3]["category"], got[3]["evidence_section"], got[3]["notes"]) == ("omega; EPA", "g", "", "body", "silver bootstrap")
    assert got[1]["notes"] == "silver bootstrap; audit=a.json;b.json"


def test_relationships_and_rejected(records):
    made = workbook.rows(records)
    r1, r2 = listed(workbook.sheet(made, "gold_relationships"))
    assert (r1["relationship_gold_id"], r1["explicit_or_implied"], r1["evidence_text"], r1["source_entity_id"]) == (key("silver_relationship", "doc:2", "c1", "r1", "CURES", "", ""), "", "", "")
    assert (r2["evidence_text"], r2["evidence_start_char"], r2["evidence_end_char"], r2["confidence_gold"], r2["explicit_or_implied"], r2["target_normalized_name"]) == ("aspirin treats", "1", "15", "0.9", "explicit", "pain")
    bad = listed(workbook.sheet(made, "rejected_candidates"))
    assert [(b["candidate_text"], b["candidate_type"], b["reason"]) for b in bad] == [
        ("pain TREATS aspirin", "relationship", "relationship direction is invalid"), ("loose words", "other", "rejected candidate is not an object"), ("", "entity", "entity is unknown")]
    assert bad[1]["rejected_id"] == key("silver_rejected", "doc:2", "c1", "loose words", "rejected candidate is not an object")


def test_violations(spark, records):
    made = workbook.rows(records)
    sheets = {name: workbook.sheet(made, name) for name in workbook.HEADERS if name != "annotation_notes"}
    assert [(v["sheet"], v["field"], v["value"]) for v in workbook.violations(sheets).collect()] == [("gold_relationships", "relationship_type", "CURES")]


def test_round_trip(spark, records, tmp_path):
    workbook.written(records, str(tmp_path / "book"))
    made = workbook.rows(records)
    back = readers.sheets(spark, str(tmp_path / "book"), [*workbook.HEADERS, "allowed_values"])
    for name, own in back.items():
        if name in ("annotation_notes", "allowed_values"):
            continue
        own = own.orderBy("row_number")
        assert own.columns == [*workbook.HEADERS[name], "row_number"]
        wanted = [tuple(r) for r in workbook.sheet(made, name).collect()]
        assert [tuple(x or "" for x in r) for r in own.drop("row_number").collect()] == wanted
        assert [r["row_number"] for r in own.select("row_number").collect()] == list(range(2, 2 + len(wanted)))
    assert back["annotation_notes"].count() == 0
    assert back["allowed_values"].where("annotation_decision <> ''").count() == 3


def test_no_records(spark):
    made = workbook.rows(spark.createDataFrame([], workbook.RECORD))
    assert made.count() == 0 and workbook.sheet(made, "chunks").columns == workbook.HEADERS["chunks"]


def test_one_scan_and_no_shuffle(spark, records):
    plan = workbook.rows(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan


def test_sums_before(spark):
    rows = [([],), ([5],), (list(range(2000)),), (None,)]
    got = spark.createDataFrame(rows, "a array<int>").select(T.sums_before(F.col("a")).alias("s")).collect()
    assert [r["s"] for r in got] == [[], [0], [sum(range(k)) for k in range(2000)], None]


def test_long_records_take_time_in_proportion(spark):
    """A record of 6,000 chunks and as many extractions, and a text of 100,000 lines."""
    chunks = F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda k: F.struct(F.concat(F.lit("c"), k).alias("id"), k.cast("int").alias("order"), F.concat(F.lit("text "), k).alias("text")))
    found = F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda k: F.struct(F.concat(F.lit("c"), k).alias("chunk_id"), F.array(F.struct(F.lit("Drug").alias("type"), F.concat(F.lit("TEXT "), k).alias("name"))).alias("entities")))
    text = spark.range(1).select(F.to_json(F.struct(F.struct(F.lit("d").alias("id")).alias("document"), chunks.alias("chunks"), found.alias("extractions"))).alias("j"))
    records = text.select(F.from_json("j", workbook.RECORD).alias("r")).select("r.*")
    began = time.time()
    got = workbook.sheet(workbook.rows(records), "gold_entities").select(F.count("*"), F.count_if(F.concat(F.lit("c"), F.substr("evidence_text", F.lit(6))) == F.col("chunk_id"))).first()
    assert tuple(got) == (6000, 6000)
    lines = spark.range(1).select(F.split(F.repeat(F.lit("a b\n"), F.lit(100_000)), "\n").alias("lines"))
    assert lines.select(F.element_at(T.sums_before(F.transform("lines", F.length)), -1)).first()[0] == 300_000
    assert time.time() - began < 60
