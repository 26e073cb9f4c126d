"""Readers: nested article JSON, id lists, question and training files, terminologies, sheets, CSV, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.order import numbered

PASSAGES = "array<struct<infons:map<string,string>,offset:int,text:string>>"


def passages(rows: DataFrame, payload: str, key: str) -> DataFrame:
    """(key, ord, section, type, source_offset, text) from nested article JSON; of several documents the first counts.

    The payload is an object with ``documents``, or a list of such; other shapes give no rows.
    """
    schema = f"array<struct<documents:array<struct<infons:map<string,string>,passages:{PASSAGES}>>>>"
    as_list = F.when(F.ltrim(payload).startswith("["), F.col(payload)).otherwise(F.concat(F.lit("["), payload, F.lit("]")))
    docs = F.flatten(F.transform(F.from_json(as_list, schema), lambda c: c["documents"]))
    one = rows.select(key, F.posexplode(F.get(docs, F.lit(0))["passages"]).alias("ord", "p"))
    info = lambda *names: T.first_of(*[F.element_at("p.infons", n) for n in names])
    return one.select(key, "ord", info("section_type", "section").alias("section"), info("type").alias("type"), F.col("p.offset").alias("source_offset"), F.coalesce("p.text", F.lit("")).alias("text"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(path, payload): one row for each JSON file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, pos, value): the lines of text files, numbered from 1 in their file and over all files in order.

    A file may be read in several splits.  Lines are ranked within their split, whose size is bounded; the numbers of
    lines of the splits, a row for each, are summed up in order.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_at"))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("file").alias("_f"), F.col("block").alias("_b"), before(W.partitionBy("file").orderBy("block")).alias("_in_file"), before(W.orderBy("file", "block")).alias("_in_all"))
    place = F.row_number().over(W.partitionBy("file", "block").orderBy("_at"))
    out = raw.withColumn("_r", place).join(starts, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    return out.select("file", (F.col("_in_file") + F.col("_r")).alias("line"), (F.col("_in_all") + F.col("_r")).alias("pos"), "value")


def id_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value, file, line): lines of id files; blank ones and those that start with # do not count, but are numbered."""
    return numbered_lines(spark, path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#")).select("pos", "value", "file", "line")


def free_ids(rows: DataFrame, text: str) -> DataFrame:
    """(pos, value): ids in free text, split at blanks and commas; lines that start with # do not count."""
    lines = rows.select(F.posexplode(F.split(text, "\n")).alias("l", "line")).where(~F.ltrim("line").startswith("#"))
    each = lines.select("l", F.posexplode(F.split("line", r"[\s,]+")).alias("k", "value")).where("value <> ''")
    return each.select((F.shiftleft(F.col("l").cast("long"), 32) + F.col("k")).alias("pos"), "value")


def distinct_ids(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, pos): normal ids, each once at its first place; an id that is none, or a negative limit, raises.  The error names the file
    and line of an id where they are known."""
    if limit is not None and limit < 0:
        raise ValueError("the limit must not be negative")
    where = F.concat_ws(":", "file", "line") if {"file", "line"} <= set(rows.columns) else None
    each = rows.select("pos", T.paper_id(F.col("value"), where).alias("id")).groupBy("id").agg(F.min("pos").alias("first"))
    each = each.orderBy("first").limit(limit) if limit is not None else each
    return numbered(each, F.col("first"), "pos").select("id", "pos")


def question_records(rows: DataFrame, prefix: str = "q") -> DataFrame:
    """(id, question, facts, entities, relationships, metadata) from (pos, value) JSON records, ids made up where absent."""
    j = F.from_json("value", "map<string,string>")
    out = numbered(rows.withColumn("j", j), F.col("pos"), "n")
    get = lambda *names: T.first_of(*[F.element_at("j", n) for n in names])
    known = ["id", "question", "message", "input", "expected_facts", "expected_entities", "expected_relationships", "answer"]
    lists = lambda n: F.coalesce(F.from_json(F.element_at("j", n), "array<string>"), F.array().cast("array<string>"))
    return out.select(F.coalesce(F.nullif(get("id"), F.lit("")), F.format_string(f"{prefix}%04d", "n")).alias("id"), get("question", "message", "input").alias("question"), lists("expected_facts").alias("facts"), lists("expected_entities").alias("entities"), lists("expected_relationships").alias("relationships"), F.map_filter("j", lambda k, v: ~k.isin(known)).alias("metadata"), get("answer").alias("answer"))


def question_file(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file (a list, or an object with ``questions``) or of a JSON-lines file."""
    raw = spark.read.text(path, wholetext=True)
    body = F.trim("value")
    listed = F.when(body.startswith("["), body).otherwise(F.get_json_object(body, "$.questions"))
    records = F.coalesce(F.from_json(listed, "array<string>"), F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""))
    return question_records(raw.select(F.posexplode(records).alias("pos", "value")))


def training_examples(rows: DataFrame) -> DataFrame:
    """Questions with an answer; where there is none, the expected facts joined by blanks."""
    return question_records(rows, "train").withColumn("answer", T.first_of(F.col("answer"), F.array_join("facts", " ")))


def concepts(spark: SparkSession, path: str, field: str = "concepts", strict: bool = False) -> DataFrame:
    """(pos, type, name, aliases, definition) of a terminology file; faulty rows are left out.

    A missing file is empty, or raises if ``strict``.
    """
    schema = f"{field} array<struct<type:string,canonical_name:string,aliases:array<string>,definition:string,source_label:string,source_url:string>>"
    try:
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception:
        if strict:
            raise
        raw = spark.createDataFrame([], schema)
    each = raw.select(F.posexplode(field).alias("pos", "c")).where("trim(c.canonical_name) <> '' and trim(c.type) <> ''")
    names = F.filter(F.transform(F.coalesce("c.aliases", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    return each.select("pos", F.trim("c.type").alias("type"), F.trim("c.canonical_name").alias("name"), names.alias("aliases"), F.coalesce("c.definition", F.lit("")).alias("definition"), F.coalesce("c.source_label", F.lit("Curated local definition")).alias("source_label"), F.coalesce("c.source_url", F.lit("")).alias("source_url"))


def sheets(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """A workbook as a folder of CSV sheets: all text, rows of nothing but nulls left out, ``row_number`` from 2.

    A sheet may be several files, which count in the order of their names; rows are ranked within their file, which one task
    reads, and the files' sizes, a row for each, are summed up.
    """
    out = {}
    for n in names:
        rows = csv_rows(spark, f"{folder.rstrip('/')}/{n}.csv")
        some = F.coalesce(*[F.col(f"`{c}`") for c in rows.columns]).isNotNull()
        own = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
        before = F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        starts = own.groupBy("_file").agg(F.count("*").alias("_n")).select(F.col("_file").alias("_f"), before.alias("_before"))
        placed = own.withColumn("_r", F.row_number().over(W.partitionBy("_file").orderBy("_at"))).join(starts, F.col("_file") == F.col("_f"))
        out[n] = placed.withColumn("row_number", F.col("_before") + F.col("_r") + 1).where(some).drop("_file", "_at", "_r", "_f", "_before")
    return out


def csv_rows(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """A CSV file with a header, every value text."""
    try:
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except Exception:
        if missing_ok:
            return spark.createDataFrame([], "value string").limit(0)
        raise


def processed(spark: SparkSession, folder: str) -> DataFrame:
    """All processed records of a folder of JSON files, an object each, with the file they come from, in file order.

    A folder without files, and a file that holds no object, raise.
    """
    bodies = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.schema_of_variant(F.try_parse_json("value")).alias("kind"))
    told = bodies.agg(F.count("*").alias("n"), F.min(F.when(~F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False)), F.col("path"))).alias("bad")).first()
    listed = bodies.inputFiles()
    if not listed:
        raise ValueError(f"no processed files in {folder}")
    if told["n"] < len(listed):  # empty files give no rows
        name = lambda p: p.rpartition("/")[2]
        found = {name(r["path"]) for r in bodies.select("path").collect()}
        told = {"bad": min(p for p in listed if name(p) not in found)}
    if told["bad"]:
        raise ValueError(f"not a JSON object: {told['bad']}")
    return spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).select("*", F.col("_metadata.file_path").alias("path")).orderBy("path")


def text_document(title: str, text: str, spark: SparkSession) -> DataFrame:
    """An uploaded text as a document of one passage."""
    row = spark.createDataFrame([(title, text)], "title string, text string")
    return row.select(T.text_document_key(F.col("title"), F.col("text")).alias("id"), "title", T.title_slug(F.col("title")).alias("slug"), F.array(F.struct(F.lit(0).alias("ord"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.col("text").alias("text"))).alias("passages"))


def exchanges(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn that the assistant answers."""
    by = W.partitionBy("conv_id").orderBy("turn")
    nxt = conversations.withColumns({"_r": F.lead("role").over(by), "_t": F.lead("text").over(by), "_n": F.lead("turn").over(by)})
    return nxt.where("role = 'user' and _r = 'assistant' and _n = turn + 1").select("conv_id", "turn", F.col("text").alias("question"), F.col("_t").alias("answer"))
