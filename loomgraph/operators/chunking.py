"""Passages, overlapping chunks, sentences and evidence windows, all with exact offsets."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SPANS = "array<struct<start:int,end:int>>"


def _check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and smaller than the chunk size")


def chunk_spans(text: Column, size: int = 6000, overlap: int = 500) -> Column:
    """Spans of overlapping chunks: up to ``size`` characters, cut at the last blank beyond 60 % of it.

    Each cut depends on the one before, so this is a vectorised UDF with one loop turn a chunk.
    """
    _check(size, overlap)
    floor = int(size * 0.6)

    def cuts(t: str | None) -> list[dict]:
        t, out, at = t or "", [], 0
        while at < len(t):
            to = min(at + size, len(t))
            if to < len(t) and (blank := t.rfind(" ", at, to)) > at + floor:
                to = blank
            if t[at:to].strip():
                out.append({"start": at, "end": to})
            if to == len(t):
                break
            at = max(to - overlap, at + 1)
        return out

    def run(s: pd.Series) -> pd.Series:
        return s.map(cuts, na_action=None)

    return F.pandas_udf(run, SPANS)(text)


def chunks(docs: DataFrame, key: str, text: str = "text", size: int = 6000, overlap: int = 500) -> DataFrame:
    """(key, ord, start, end, text): one row per chunk, ord from 1."""
    each = docs.select(F.col(key), F.col(text).alias("_t"), F.posexplode(chunk_spans(F.col(text), size, overlap)).alias("p", "s"))
    body = F.btrim(F.substr("_t", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), F.lit(" \t\n\r\x0b\x0c"))
    return each.select(key, (F.col("p") + 1).alias("ord"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), body.alias("text"))


def chunk_id(prefix: Column, order: Column) -> Column:
    return F.concat(prefix, F.format_string("-chunk-%04d", order))


def passage_offsets(passages: DataFrame, key: str, order: str, text: str = "text", gap: int = 2) -> DataFrame:
    """Adds char_start and char_end: passages stand one after the other, ``gap`` characters between them."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = passages.withColumn("char_start", F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0)).cast("int"))
    return out.withColumn("char_end", F.col("char_start") + F.length(text))


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ord, text): the lines of each document as passages, ord from 0."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("ord", "text"))


def overlapping(chunk_rows: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """(key, ord, n_passages, first_section, sections): sections of the passages that each chunk overlaps, in order.

    An equi-join on the document with the interval test as residual.
    """
    c = chunk_rows.select(key, F.col("ord").alias("chunk"), "start", "end")
    p = passages.select(F.col(key).alias("_k"), F.col("ord").alias("p"), "section", "char_start", "char_end")
    met = c.join(p, (F.col(key) == F.col("_k")) & (F.col("char_start") < F.col("end")) & (F.col("char_end") > F.col("start")))
    found = F.array_sort(F.collect_list(F.struct("p", "section")))
    out = met.groupBy(key, F.col("chunk").alias("ord")).agg(F.count("*").alias("n_passages"), found.alias("f"))
    return out.select(key, "ord", "n_passages", F.get("f", F.lit(0))["section"].alias("first_section"), F.array_distinct(F.filter(F.transform("f", lambda x: x["section"]), lambda x: x != "")).alias("sections"))


def sentence_spans(text: Column) -> Column:
    """Sentences by closing marks and line ends: start after leading blanks, end before the break."""

    def cut(t: str | None) -> list[dict]:
        t, out, at = t or "", [], 0
        breaks = [(m.start(), m.end()) for m in re.finditer(r"(?<=[.!?])\s+|\n+", t)] + [(len(t), len(t))]
        for end, after in breaks:
            part = t[at:end]
            if part.strip():
                out.append({"start": at + len(part) - len(part.lstrip()), "end": end, "s": part.strip()})
            at = after
        return out

    def run(s: pd.Series) -> pd.Series:
        return s.map(cut, na_action=None)

    return F.pandas_udf(run, "array<struct<start:int,end:int,s:string>>")(text)


def sentences(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, start, end, sentence)."""
    return docs.select(key, F.posexplode(sentence_spans(F.col(text))).alias("pos", "x")).select(key, "pos", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.col("x.s").alias("sentence"))


def windows(sentence_rows: DataFrame, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, w, start, end, window): the sentences, then each pair of neighbours."""
    by = W.partitionBy(key).orderBy("pos")
    s = sentence_rows.withColumn("to", F.lead("end").over(by)).withColumn("n", F.count("*").over(W.partitionBy(key)))
    single = s.select(key, F.col("pos").alias("w"), "start", "end", F.col("sentence").alias("window"))
    pairs = s.where("to is not null").join(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), F.col(key) == F.col("_k"))
    pair = F.btrim(F.substr("_t", F.col("start") + 1, F.col("to") - F.col("start")), F.lit(" \t\n\r\x0b\x0c"))
    return single.unionByName(pairs.select(key, (F.col("n") + F.col("pos")).cast("int").alias("w"), "start", F.col("to").alias("end"), pair.alias("window")).where("window <> ''"))
