"""Secrets: fixed patterns, and Markov models of random strings against ordinary identifiers.

Base kinds (assign, access, hex) follow the fixed rules below, leftmost and non-overlapping per
kind.  The method adds ``markov`` spans: strings of 20 or more token characters with a digit
and a letter, outside base spans, whose characters are likelier under a first-order Markov
model of random strings than under one of identifiers, by ``PER_CHAR`` nats a character.
Both models are trained from labelled samples (``samples`` or a caller's own table).

Only DataFrame functions, within the row, no shuffle; the trained table has at most 70 x 70
entries whatever the input.  Defined cases: a null or empty text has no spans; repeated rows have
equal results; null keys pass through; an empty table gives an empty result; input columns with
the names of added ones are replaced.  Ties: spans that start at one place are listed by kind.  Very long
texts and runs take time in proportion to their length: the patterns' repeats are possessive.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native_spans import bound, found, listed, of_kind, ordered, packed, places_sql, scanned, unpacked

KINDS = ["assign", "access", "hex", "markov"]
BASE = 3
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
PER_CHAR = 0.35
#: Parts of ordinary identifiers, for the labelled sample.
PARTS = (
    "account action address admin amount annotation answer api archive array async author batch buffer build bytes call channel check client cluster code "
    "column command comment commit config connection container content context control create current customer data database date default delete "
    "description detail document domain email enable entity entry error event example export field file filter folder format function group handler header "
    "height history host image import index input interface internal item job key label language layer length library limit line link list load local "
    "location logger manager message method metric model module name network node notification number option order output owner package page parameter "
    "parent parser partition path payment person position process product profile project property public query queue range rate reader record reference "
    "release render report request resource response result return role root route row schema search security sequence server service session setting size "
    "source stage start state status storage stream string subject switch system table tag target task test text thread time title total transaction type "
    "update upload user valid value version view worker writer"
).split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(sample, random): half random strings, half identifiers, the same on every call."""
    parts = F.array(*[F.lit(p) for p in PARTS])
    pick = lambda k: F.get(parts, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))).cast("int"))
    raw = F.sha2(F.col("id").cast("string"), 256)
    rows = spark.range(0, n, numPartitions=1)
    tail = F.when(F.col("id") % 3 == 0, F.concat(F.lit("_"), (F.col("id") % 97).cast("string"))).when(F.col("id") % 3 == 1, F.concat(F.lit("-v"), (F.col("id") % 10).cast("string"))).otherwise("")
    noise = F.when(F.col("id") % 2 == 0, F.base64(F.unhex(raw))).otherwise(raw)
    snake, camel = F.concat_ws("_", pick(1), pick(2), pick(3)), F.concat(pick(1), F.initcap(pick(2)), F.initcap(pick(3)))
    dashed, caps = F.concat_ws("-", pick(1), pick(2), pick(3)), F.upper(F.concat_ws("_", pick(1), pick(2)))
    plain = F.concat(F.element_at(F.array(snake, camel, dashed, caps), (F.col("id") % 4 + 1).cast("int")), tail)
    return rows.select(noise.alias("sample"), F.lit(True).alias("random")).union(rows.select(plain, F.lit(False)))


def _code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def trained(samples: DataFrame) -> Column:
    """log P(next | char) under the random model minus the same under the identifier model, as one constant array."""
    chars = F.filter(F.split("sample", ""), lambda c: F.length(c) == 1)
    s = samples.select("random", chars.alias("c"))
    pairs = s.select("random", F.explode(F.transform("c", lambda c, i: F.when(F.get("c", i + 1).isNotNull(), F.instr(F.lit(ALPHABET), c) * WIDTH + F.instr(F.lit(ALPHABET), F.get("c", i + 1))))).alias("p"))
    counts = pairs.where("p is not null").groupBy("p").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    found = {row["p"]: (row["r"], row["o"]) for row in counts.collect()}  # at most WIDTH * WIDTH rows
    return F.split(F.lit(",".join(ratios(found))), ",").cast("array<double>")


def ratios(counts: dict[int, tuple[int, int]]) -> list[str]:
    """log P(next | char) of random strings over that of identifiers, for all pairs, from (random, ordinary) counts by pair."""
    values = []
    for a in range(WIDTH):
        own = [counts.get(a * WIDTH + b, (0, 0)) for b in range(WIDTH)]
        sums = [sum(x[k] for x in own) for k in (0, 1)]
        values += [math.log((r + 0.5) / (sums[0] + 0.5 * WIDTH)) - math.log((o + 0.5) / (sums[1] + 0.5 * WIDTH)) for r, o in own]
    return [f"{v:.4f}" for v in values]


def llr(s: Column, table: Column) -> Column:
    """Log-likelihood ratio (random over ordinary) of a string, per character pair."""
    codes = F.transform(F.split(s, ""), _code)
    first = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("last"), F.when(a["last"] < 0, 0.0).otherwise(a["sum"] + F.get(table, a["last"] * WIDTH + c)).alias("sum"))
    return F.aggregate(codes, first, step, lambda a: a["sum"]) / F.greatest(F.length(s) - 1, F.lit(1))


def with_spans(df: DataFrame, text: str = "text", into: str = "secrets", model: Column | None = None, per_char: float = PER_CHAR) -> DataFrame:
    """``df`` with all secrets: array of (start, end, kind, s), by start and kind."""
    table = trained(samples(df.sparkSession)) if model is None else model
    own = packed(df, text, (into,)).withColumns(
        {
            "_0": F.filter(found("_t", ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 1)) >= 8),
            "_1": found("_t", ACCESS, 1, F.contains("_t", F.lit("AKIA"))),
            "_2": found("_t", HEX, 2),
            "_3": found("_t", CANDIDATE, 3),
        }
    )
    own = own.withColumn("_b", ordered(F.col("_0"), F.col("_1"), F.col("_2")))
    every = bound(ordered(F.col("_b"), F.col("_3")), lambda spans: F.filter(_clear(spans), lambda x: x["clear"] & ((x["x"]["kind"] < BASE) | (llr(x["x"]["s"], table) >= per_char))))
    return unpacked(own.withColumn(into, F.when(F.size("_3") > 0, F.transform(every, lambda x: x["x"])).otherwise(F.col("_b"))), (into,))


def _clear(spans: Column) -> Column:
    """(x, clear) for each span, in order of their starts: whether it is a base span, or one that overlaps none of them."""
    most = F.lit(2**31 - 1)
    base = lambda x: x["kind"] < BASE
    # how far the base spans before it reach, and where the first one after it starts
    reach = scanned(F.transform(spans, lambda x: F.when(base(x), x["end"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    next_ = F.reverse(scanned(F.reverse(F.transform(spans, lambda x: F.when(base(x), x["start"]).otherwise(most))), most, lambda a, x: F.least(a, x)))
    free = lambda x, z: base(x) | ((z["reach"] <= x["start"]) & (z["next"] >= x["end"]))
    return F.zip_with(spans, F.arrays_zip(reach.alias("reach"), next_.alias("next")), lambda x, z: F.struct(x.alias("x"), free(x, z).alias("clear")))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    docs = docs.withColumn("_base", F.filter("secrets", lambda x: x["kind"] < BASE))
    counts = {f"n_{k}": F.size(F.filter("_base", of_kind(i))).cast("long") for i, k in enumerate(KINDS[:BASE])}
    return docs.select("doc_id", *[c.alias(k) for k, c in counts.items()], F.sha2(listed(F.col("_base"), KINDS), 256).alias("base_sha256"), listed(F.col("secrets"), KINDS).alias("spans"))


def plain_samples(n: int = 4000) -> list[tuple[str, bool]]:
    """``samples`` restated without Spark, for the SQL."""
    import xxhash

    def pick(i: int, k: int) -> str:
        first = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)
        h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), first)
        return PARTS[(h - (1 << 64) if h >> 63 else h) % len(PARTS)]

    out = []
    for i in range(n):
        raw = hashlib.sha256(str(i).encode()).hexdigest()
        out.append((base64.b64encode(bytes.fromhex(raw)).decode() if i % 2 == 0 else raw, True))
        a, b, c = (pick(i, k) for k in (1, 2, 3))
        plain = [f"{a}_{b}_{c}", a + b.capitalize() + c.capitalize(), f"{a}-{b}-{c}", f"{a}_{b}".upper()][i % 4]
        out.append((plain + [f"_{i % 97}", f"-v{i % 10}", ""][i % 3], False))
    return out


def oracle() -> str:
    """The query in SQL; the trained table is a constant there."""
    counts: Counter[tuple[int, bool]] = Counter()
    for s, random in plain_samples():
        code = [ALPHABET.find(c) + 1 for c in s]
        counts.update((a * WIDTH + b, random) for a, b in zip(code[:-1], code[1:], strict=True))
    table = ", ".join(ratios({p: (counts[p, True], counts[p, False]) for p, _ in counts}))
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""
    names = "CASE kind " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS)) + " END"
    quoted = assign.replace("'", "''")
    return f"""WITH {places_sql([assign, "AKIA[A-Z0-9]+", "[0-9a-f]+", "[A-Za-z0-9+/_=-]+"])},
tab AS (SELECT CAST([{table}] AS DOUBLE[]) AS v),
n AS (SELECT *, start + length(s) AS stop FROM y WHERE CASE kind WHEN 0 THEN length(regexp_extract(s, '{quoted}', 1)) >= 8 WHEN 1 THEN length(s) >= 16 WHEN 2 THEN length(s) >= 32 ELSE length(s) >= 20 AND regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') END),
m AS (SELECT n.*, list_sum(list_transform(range(1, length(s)), lambda i: v[instr('{ALPHABET}', substr(s, i, 1)) * {WIDTH} + instr('{ALPHABET}', substr(s, i + 1, 1)) + 1])) / (length(s) - 1) AS llr FROM n, tab
  WHERE kind = {BASE} AND NOT EXISTS (SELECT 1 FROM n b WHERE b.doc_id = n.doc_id AND b.kind < {BASE} AND b.start < n.stop AND n.start < b.stop)),
a AS (SELECT doc_id, kind, start, {names} || ':' || start || ':' || stop AS x FROM (SELECT doc_id, kind, start, stop FROM n WHERE kind < {BASE} UNION ALL SELECT doc_id, kind, start, stop FROM m WHERE llr >= {PER_CHAR})),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{KINDS[k]}" for k in range(BASE))}, string_agg(x, ',' ORDER BY start, kind) FILTER (WHERE kind < {BASE}) AS b, string_agg(x, ',' ORDER BY start, kind) AS spans FROM a GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{KINDS[k]}, 0) AS BIGINT) AS n_{KINDS[k]}" for k in range(BASE))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
