"""Positions of regular-expression matches with DataFrame functions alone.

Splitting a text by a pattern and extracting all matches of that pattern see the same
leftmost, non-overlapping matches, so the running lengths of gaps and matches give every
match's place in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:int,s:string>>"
#: Entries of an array that scanned() works on at once, and characters of a text's chunks.
BLOCK, CHUNK = 256, 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, though lambdas in ``use`` mention it for each entry of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an integer array, all earlier ones merged, from ``zero`` on; ``merge`` must be associative.

    A fold that appends copies its array every time.  Here a fold runs over a block of entries, and one over the blocks, so no
    array that grows is longer than BLOCK or the number of blocks.
    """
    none = F.array().cast("array<int>")

    def before(own: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), none.alias("out"))
        step = lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
        return F.aggregate(own, first, step, lambda a: a["out"])

    def cut(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))).otherwise(none)
        return F.transform(places, lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, merge))
        return F.flatten(F.zip_with(blocks, before(sums, zero), before))

    return bound(bound(values, cut), whole)


def chunks(text: Column) -> Column:
    """The text cut into CHUNK characters each, for part()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(cut: Column, at: Column, n: Column) -> Column:
    """``n`` characters from place ``at`` on, in time in proportion to n, not to at."""
    first = F.floor(at / CHUNK).cast("int")
    last = F.floor((at + F.greatest(n, F.lit(1)) - 1) / CHUNK).cast("int")
    return F.substr(F.array_join(F.slice(cut, first + 1, last - first + 1), ""), at % CHUNK + 1, n)


def found(text: str, pattern: str, kind: int, needs: Column | None = None) -> Column:
    """All matches of ``pattern`` in column ``text`` as (start, end, kind, s).

    ``pattern`` must not match the empty string.  ``needs``: a cheap test that holds for every
    text with a match; texts that fail it are not split.
    """
    gaps = F.split(text, pattern, -1)

    def placed(hits: Column) -> Column:
        # the last gap has no match after it; the others end where the next match starts
        lengths = F.zip_with(gaps, hits, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
        ends = F.slice(scanned(lengths, F.lit(0), lambda a, x: a + x), F.lit(2), F.size(hits))
        return F.zip_with(hits, ends, lambda s, e: F.struct((e - F.length(s)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), s.alias("s")))

    placed = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    there = F.regexp_like(text, F.lit(pattern)) if needs is None else needs & F.regexp_like(text, F.lit(pattern))
    return F.when(there, placed).otherwise(F.array().cast(SPAN))


def packed(df: DataFrame, text: str, without: tuple[str, ...]) -> DataFrame:
    """(row, _t): all columns but ``without`` as one struct, so that no name can clash, and the text, "" for null."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {w.lower() for w in without}]
    return df.select(F.struct(*kept, F.lit(None).cast("int").alias("__")).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))


def unpacked(df: DataFrame, added: tuple[str, ...]) -> DataFrame:
    """The columns of ``row`` and the added ones.

    A condition that a caller puts on them must not be pushed below the expressions that make them, where
    they would be copied into it, once for each mention: the last of them is tied to the partition, which
    keeps conditions above.
    """
    kept = [f.name for f in df.schema["row"].dataType.fields if f.name != "__"]
    here = F.when(F.spark_partition_id() >= 0, F.col(added[-1])).alias(added[-1])
    return df.select(*[F.col("row")[c].alias(c) for c in kept], *added[:-1], here)


def fresh(df: DataFrame, stem: str) -> str:
    """A name that no column of ``df`` has."""
    while stem.lower() in {c.lower() for c in df.columns}:
        stem = "_" + stem
    return stem


def of_kind(kind: int) -> Callable[[Column], Column]:
    """A test of spans; a function of one argument, since filter() gives functions of two the place as well."""
    return lambda x: x["kind"] == kind


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, by start and then by the order of ``kinds``, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def ordered(*arrays: Column) -> Column:
    """All spans of the arrays, by (start, kind, end)."""
    key = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["s"].alias("s"))
    back = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["s"].alias("s"))
    return F.transform(F.sort_array(F.transform(F.concat(*arrays), key)), back)


def places_sql(patterns: list[str]) -> str:
    """CTEs d (doc_id, t) and y (doc_id, t, kind, s, start): all matches of each pattern in the whole texts, by the gaps between them."""
    rows = ", ".join("(%d, '%s')" % (k, p.replace("'", "''")) for k, p in enumerate(patterns))
    return f"""d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p(kind, rx) AS (VALUES {rows}),
x AS (SELECT doc_id, t, kind, i, hits[i] AS s, length(gaps[i]) AS g FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, t, kind, regexp_extract_all(t, rx) AS hits, string_split_regex(t, rx) AS gaps FROM d, p))),
y AS (SELECT doc_id, t, kind, s, CAST(sum(g + length(s)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(s) AS BIGINT) AS start FROM x)"""
