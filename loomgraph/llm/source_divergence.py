"""How far the sources of a language diverge: sums over joint histograms of their term counts.

Terms are runs of letters and characters beyond ASCII, with A-Z lower-cased.  A language keeps the V terms that are
in at least ``LEAST_DOCS`` of its documents.  A group (a source of a language), or a language, that has a kept term ``count``
times and N kept terms in all gives it p = 1 + floor(ONE * (count + 2) / (N + 2 * V)).  The divergence of two such is the sum
over the kept terms of f(p, q) = floor((p - q) ** 2 / (p + q)).

1. One pass over the texts counts terms in Arrow batches: (lang, source, term, occurrences, documents), added up in
   each task before the one shuffle, by (lang, term).  Kept terms and their totals come from the same shuffle.
2. f depends on a pair of counts alone, so a pair of groups needs its joint histogram only: how many terms have the counts
   (c, d).  The groups of a language are numbered and cut into blocks of ``BLOCK``; a term's counts go to the
   cells (block, block), and a batch of terms is a matrix of counts, with zeros for the groups that lack a term, from which each
   pair's combinations are tallied.  Terms that neither of the two has are not stored: their number is V less the rest.
3. The histograms are added up; f is evaluated once for each distinct (c, d) of a pair, and summed times the multiplicity.

Arithmetic is exact: p by long division in steps of 1,000 (exact while N + 2 * V < 9.2e15), f and its sums in
64-bit integers (sums are at most 2 * ONE + 2 * V).

Defined cases: a null text, language or source counts as ''; a text without terms still makes its group occur; a language without
kept terms has pairs of value 0 and no terms; a group without others in its language has no pairs; repeated rows count each;
ties go to the smaller item by its UTF-8 bytes; very long texts are scanned whole; an empty table gives an empty
result; other columns are ignored.  Rows of a hot source or language are added up by term before they are shuffled, and the pairs of a
language are dealt by blocks.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scan
from .folders import checkpointed
from ..shipping import ship

LEAST_DOCS = 10
TOP_TERMS = 10
ONE = 1_000_000_000
#: Groups of a language that a side of a cell has at most.
BLOCK = 128
#: Terms tallied at once, and rows of counts that a task adds up before it hands them on.
TERMS, HELD = 4096, 1 << 20

TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True


def _counted(b: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of a batch (lang, source, text)."""
    buf, offsets = scan.texts_of(b.column("text"))
    buf = scan.LOWER[buf]
    starts, ends = scan.spans(buf, offsets, TERM)
    # words and the gaps between them partition the buffer; equal words are found by a hash table that compares bytes
    bounds = np.append(np.stack([starts, ends], 1).ravel(), len(buf)).astype(np.int64)
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(buf)])
    distinct = pc.dictionary_encode(every.take(pa.array(np.arange(0, 2 * len(starts), 2))))
    doc = np.repeat(np.arange(b.num_rows), np.diff(np.searchsorted(starts, offsets)))
    width = max(1, len(distinct.dictionary))
    code, n = np.unique(doc * width + np.asarray(distinct.indices), return_counts=True)
    term, doc = distinct.dictionary.cast(pa.large_string()).take(pa.array(code % width)), pa.array(code // width)
    out = pa.table({"lang": b.column("lang").cast(pa.large_string()).take(doc), "source": b.column("source").cast(pa.large_string()).take(doc), "term": term, "n": n, "docs": np.ones(len(n), np.int64)})
    return _added([out])


def _added(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for b in scan.pieces_of(batches, "text"):
        held.append(_counted(b))
        if sum(t.num_rows for t in held) > HELD:
            held = [_added(held)]
            if held[0].num_rows > HELD // 2:  # little is repeated: hand it on
                yield from held.pop().to_batches()
    if held:
        yield from _added(held).to_batches()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total): the counts of the kept terms in each group, and in the whole language."""
    ship(docs.sparkSession)
    own = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = own.mapInArrow(_counts, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    found = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    found = found.select("*", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("in_docs"))
    return found.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "total")


def groups(docs: DataFrame, counts: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, g, many, size, v, of_lang): the number of each group in its language and how many there are, its kept
    terms (N), and V and N of the language."""
    every = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = counts.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("of_lang"))
    own = Window.partitionBy("lang")
    out = every.join(sizes, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["size", "v", "of_lang"])
    numbered = (F.row_number().over(own.orderBy("source")) - 1).cast("int")
    return out.select("lang", "source", numbered.alias("g"), F.count("*").over(own).cast("int").alias("many"), "size", "v", "of_lang")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, size: Column, v: Column) -> Column:
    """1 + floor(ONE * (count + 2) / (size + 2 * v)) in 64-bit integers."""
    of = size + 2 * v
    rest, out = count + 2, F.lit(0).cast("long")
    for _ in range(3):  # ONE is 1000 ** 3
        out, rest = out * 1000 + _div(rest * 1000, of), rest * 1000 % of
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """Rows with the language's ``many`` and a group ``g``, once for each cell (i, j), i <= j, that the group's block is in."""
    own, last = _div(F.col("g"), F.lit(block)).cast("int"), _div(F.col("many") - 1, F.lit(block)).cast("int")
    out = rows.withColumn("o", F.explode(F.sequence(F.lit(0), last)))
    return out.select(*rows.columns, F.least(own, "o").alias("i"), F.greatest(own, "o").alias("j"))


def _tallied(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """From rows (lang, many, i, j, of), a term of a cell each: (lang, a, b, c, d, m), the number of terms that group a has c
    times and group b > a has d times."""
    for whole in batches:
        for at in range(0, whole.num_rows, TERMS):
            b = whole.slice(at, TERMS)
            lang = pc.dictionary_encode(b.column("lang"))
            key = np.stack([np.asarray(lang.indices), *[np.asarray(b.column(c)) for c in ("many", "i", "j")]], 1)
            cells, of = np.unique(key, axis=0, return_inverse=True)
            term = np.repeat(np.arange(b.num_rows), np.asarray(b.column("of").value_lengths()))
            entry = b.column("of").flatten()
            g, n = np.asarray(entry.field("g")), np.asarray(entry.field("n"))
            for k, (name, many, i, j) in enumerate(cells.tolist()):
                mine = of.ravel()[term] == k
                columns = _cell(term[mine], g[mine], n[mine], *[np.arange(x * block, min(x * block + block, many)) for x in (i, j)])
                names = pa.array([lang.dictionary[name].as_py()] * len(columns[0]), pa.string())
                yield pa.RecordBatch.from_arrays([names, *[pa.array(x, pa.int64()) for x in columns]], ["lang", "a", "b", "c", "d", "m"])


def _cell(term: np.ndarray, g: np.ndarray, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[np.ndarray]:
    """a, b, c, d, m of all pairs of a group of ``first`` and a later one of ``second``; (0, 0) is left out."""
    every = np.union1d(first, second)
    values, code = np.unique(np.append(n, 0), return_inverse=True)  # counts as small numbers; 0 is the first
    own, column = np.unique(term, return_inverse=True)
    matrix = np.zeros((len(every), len(own)), np.int64)
    matrix[np.searchsorted(every, g), column] = code[:-1]
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for x in first.tolist():
        others = second[second > x]
        joint = matrix[np.searchsorted(every, x)] * len(values) + matrix[np.searchsorted(every, others)]
        of, times = np.unique(np.arange(len(others))[:, None] * len(values) ** 2 + joint, return_counts=True)
        pair, joint = np.divmod(of, len(values) ** 2)
        some = joint > 0
        found = (np.full(len(of), x), others[pair], values[joint // len(values)], values[joint % len(values)], times)
        for own_column, more in zip(out, found, strict=True):
            own_column.append(more[some])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def pair_sums(counts: DataFrame, of: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, value) for every two groups a < b of a language."""
    n_of = counts.join(of.select("lang", "source", "g", "many"), ["lang", "source"]).select("lang", "term", "many", "g", "n")
    terms = _cells(n_of, block).groupBy("lang", "many", "i", "j", "term").agg(F.collect_list(F.struct("g", "n")).alias("of")).drop("term")
    joint = terms.mapInArrow(lambda batches: _tallied(batches, block), "lang string, a long, b long, c long, d long, m long").groupBy("lang", "a", "b", "c", "d").agg(F.sum("m").alias("m"))
    side = lambda x: of.select("lang", F.col("g").cast("long").alias(x), F.col("size").alias(f"{x}_size"), "v", "many")
    f = lambda c, d: divergence(share(c, F.col("a_size"), F.col("v")), share(d, F.col("b_size"), F.col("v")))
    cells = joint.join(side("a").drop("many"), ["lang", "a"]).join(side("b").drop("v", "many"), ["lang", "b"])
    sums = cells.groupBy("lang", "a", "b").agg(F.sum(f(F.col("c"), F.col("d")) * F.col("m")).alias("sum"), F.sum("m").alias("m"))
    # all pairs, dealt by the blocks of their groups; the rest of a pair's terms are in neither
    left = side("a").withColumn("g", F.col("a"))
    right = side("b").withColumn("g", F.col("b")).drop("v")
    every = _cells(left, block).drop("g", "many").join(_cells(right, block).drop("g", "many"), ["lang", "i", "j"]).where("a < b").where(f"a div {block} = i and b div {block} = j")
    every = every.join(sums, ["lang", "a", "b"], "left").fillna(0, ["sum", "m"])
    zero = F.lit(0).cast("long")
    value = F.when(F.col("v") == 0, zero).otherwise(F.col("sum") + f(zero, zero) * (F.col("v") - F.col("m")))
    return every.select("lang", "a", "b", value.alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair" has the divergence of each group from each other source of its
    language, part "term" the ``top`` terms that the group has more of than its language, by their share of the divergence."""
    counts = checkpointed(term_counts(docs, text, lang, source, least_docs))
    of = checkpointed(groups(docs, counts, lang, source))
    pairs = pair_sums(counts, of, block)
    both = pairs.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "value")
    named = lambda x, name: of.select("lang", F.col("g").cast("long").alias(x), F.col("source").alias(name))
    both = both.select("lang", "p.a", "p.b", "value").join(named("a", "source"), ["lang", "a"]).join(named("b", "item"), ["lang", "b"])
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
    p, q = share(F.col("n"), F.col("size"), F.col("v")), share(F.col("total"), F.col("of_lang"), F.col("v"))
    terms = counts.join(of.drop("g", "many"), ["lang", "source"]).withColumn("p", p).withColumn("q", q).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return both.unionByName(terms.withColumn("rank", place).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s ON s.lang = d.lang AND s.source = d.source GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(pairs.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
rows AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) r WHERE part = 'pair' OR rank <= 10
"""
