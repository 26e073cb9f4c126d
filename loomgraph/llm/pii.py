"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Base kinds (email, ip, card, phone) follow the fixed rules below, leftmost and non-overlapping
per kind.  The method adds ``iban`` spans (ISO 7064 mod-97) and ``ssn`` spans; an added span is
reported if its score, after the context words near it are counted, reaches ``THRESHOLD``.
Base spans are always reported; context only moves their score.

Only DataFrame functions, within the row, no shuffle.  Defined cases: a null or empty text has
no spans; repeated rows have equal results; null keys pass through; an empty table gives an
empty result; input columns with the names of added ones are replaced.  Ties: spans that start at one place are listed by
kind and then by end; all are reported.  Whole texts are scanned; the patterns use possessive repeats, so very long runs need neither quadratic time
nor deep recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native_spans import SPAN, bound, chunks, found, fresh, listed, of_kind, ordered, packed, part, places_sql, scanned, unpacked

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4
#: Score of a confirmed span without context, and the score from which an added span is reported.
SCORES = [0.9, 0.7, 0.8, 0.7, 0.9, 0.3]
THRESHOLD = 0.5
NEAR = 40
BOOST = 0.3
#: Words that speak for a kind when they stand within NEAR characters before it.
CONTEXT = [
    "mail|contact|write to|correo|courriel",
    "address|server|host|client|login",
    "card|credit|visa|mastercard|amex|payment|karte|carte|tarjeta",
    "phone|tel|call|mobile|fax|telefon|cell",
    "iban|bank|account|konto|compte|cuenta",
    "ssn|social security|taxpayer|tax id",
]
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn checksum."""
    twice = F.transform(F.split(F.reverse(number), ""), lambda c, i: c.cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without blanks passes the ISO 7064 mod-97 check."""
    turned = F.split(F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97)) == 1


def with_spans(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``df`` with the spans of every kind: array of (start, end, kind, s, score), by start and kind."""
    own = packed(df, text, (into,)).withColumn("_d", F.regexp_like("_t", F.lit("[0-9]")))
    n = lambda s: F.length(digits(s))
    own = own.withColumns(
        {
            "_0": found("_t", EMAIL, 0, F.contains("_t", F.lit("@"))),
            "_1": F.filter(found("_t", IP, 1, F.col("_d")), lambda x: F.regexp_like(x["s"], F.lit(rf"\A{_PART}(?:\.{_PART}){{3}}\z"))),
            "_2": F.filter(found("_t", CARD, 2, F.col("_d")), lambda x: n(x["s"]).between(12, 19) & luhn(digits(x["s"]))),
            "_3": F.filter(found("_t", PHONE, 3, F.col("_d")), lambda x: n(x["s"]).between(9, 15)),
            "_4": F.filter(found("_t", IBAN, 4, F.col("_d")), lambda x: mod97(F.replace(x["s"], F.lit(" "), F.lit("")))),
            "_5": found("_t", SSN, 5, F.col("_d")),
        }
    )
    own = own.withColumn("_a", ordered(*[F.col(f"_{k}") for k in range(len(KINDS))]))
    words = F.array(*[F.lit(rf"(?i)\b(?:{w})") for w in CONTEXT])
    plain = F.array(*[F.lit(x) for x in SCORES])

    def scored(x: Column, cut: Column) -> Column:
        before = part(cut, F.greatest(x["start"] - NEAR, F.lit(0)), F.least(x["start"], F.lit(NEAR)))
        score = F.least(F.lit(1.0), F.get(plain, x["kind"]) + F.when(F.regexp_like(before, F.get(words, x["kind"])), BOOST).otherwise(0.0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["s"].alias("s"), score.alias("score"))

    every = bound(chunks(F.col("_t")), lambda cut: F.transform("_a", lambda x: scored(x, cut)))
    own = own.withColumn(into, F.when(F.size("_a") > 0, F.filter(every, lambda x: (x["kind"] < BASE) | (x["score"] >= THRESHOLD))).otherwise(F.array().cast(SPAN.replace("s:string", "s:string,score:double"))))
    return unpacked(own, (into,))


def redacted(text: str, spans: str) -> Column:
    """The text with every span, overlapping ones merged, replaced by its kind in brackets."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # how far the spans before each one reach: one that starts within them is merged into them
    reach = scanned(F.transform(spans, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
    new = lambda x, at: F.when(x["start"] >= at, F.struct(x["kind"].alias("kind"), at.alias("at"), (x["start"] - at).alias("n")))
    kept = F.filter(F.zip_with(spans, reach, new), lambda x: x.isNotNull())
    done = bound(chunks(F.col(text)), lambda cut: F.array_join(F.transform(kept, lambda x: F.concat(part(cut, x["at"], x["n"]), F.get(names, x["kind"]))), ""))
    rest = F.substr(text, F.array_max(F.transform(spans, lambda x: x["end"])) + 1)
    return F.when(F.size(spans) > 0, F.concat(done, rest)).otherwise(F.col(text))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its personal data replaced; same columns, in the same order."""
    spans = fresh(df, "_pii")
    return with_spans(df, text, spans).withColumn(text, redacted(text, spans)).select(*[F.col(f"`{c}`") for c in df.columns])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    docs = docs.withColumn("_base", F.filter("pii", lambda x: x["kind"] < BASE))
    counts = {f"n_{k}": F.size(F.filter("_base", of_kind(i))).cast("long") for i, k in enumerate(KINDS[:BASE])}
    return docs.select(
        "doc_id", *[c.alias(k) for k, c in counts.items()], F.sha2(listed(F.col("_base"), KINDS), 256).alias("base_sha256"), listed(F.col("pii"), KINDS).alias("spans"), F.coalesce(F.array_max(F.transform("pii", lambda x: x["score"])), F.lit(0.0)).alias("top_score")
    )


_KIND = "CASE kind " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(KINDS)) + " END"
_CONTEXT = "CASE kind " + " ".join(f"WHEN {k} THEN '(?i)(^|[^\\pL\\p{{Nd}}_])({w})'" for k, w in enumerate(CONTEXT)) + " END"
# an IBAN stands between characters that are no letters or digits: "_", which \b takes for one, is masked (the lengths stay)
_IBAN = r"\b[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?\b"
_RX = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]", _IBAN, "[0-9-]+"]
ORACLE = f"""WITH {places_sql(_RX).replace("regexp_extract_all(t, rx)", "regexp_extract_all(m, rx)").replace("string_split_regex(t, rx)", "string_split_regex(m, rx)").replace("FROM d, p)", "FROM (SELECT *, CASE WHEN kind = 4 THEN replace(t, '_', '-') ELSE t END AS m FROM d, p))")},
n AS (SELECT *, start + length(s) AS stop, regexp_replace(s, '[^0-9]', '', 'g') AS n, replace(s, ' ', '') AS c FROM y),
v AS (SELECT *, CASE kind WHEN 0 THEN true WHEN 1 THEN regexp_full_match(s, '{_PART}(\\.{_PART}){{3}}')
  WHEN 2 THEN length(n) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(n), i, 1) AS INT) WHEN CAST(substr(reverse(n), i, 1) AS INT) > 4 THEN 2 * CAST(substr(reverse(n), i, 1) AS INT) - 9 ELSE 2 * CAST(substr(reverse(n), i, 1) AS INT) END)) % 10 = 0
  WHEN 3 THEN length(n) BETWEEN 9 AND 15
  WHEN 4 THEN list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr(c, 5) || substr(c, 1, 4), ''), lambda h: CASE WHEN ascii(h) >= 65 THEN CAST(ascii(h) - 55 AS VARCHAR) ELSE h END), ''), ''), lambda h: TRY_CAST(h AS INT)), lambda a, b: (a * 10 + b) % 97) = 1
  ELSE regexp_full_match(s, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AND NOT regexp_matches(s, '^(000|666|9)|^....00|0000$') END AS ok FROM n),
r AS (SELECT *, least(CAST(1 AS DOUBLE), CAST([{", ".join(map(str, SCORES))}][kind + 1] AS DOUBLE) + CASE WHEN regexp_matches(substr(t, greatest(start - {NEAR}, 0) + 1, least(start, {NEAR})), {_CONTEXT}) THEN CAST({BOOST} AS DOUBLE) ELSE 0 END) AS score FROM v WHERE ok),
a AS (SELECT doc_id, kind, start, stop, score, {_KIND} || ':' || start || ':' || stop AS x FROM r WHERE kind < {BASE} OR score >= {THRESHOLD}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{KINDS[k]}" for k in range(BASE))}, string_agg(x, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < {BASE}) AS b, string_agg(x, ',' ORDER BY start, kind, stop) AS spans, max(score) AS top_score FROM a GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{KINDS[k]}, 0) AS BIGINT) AS n_{KINDS[k]}" for k in range(BASE))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(top_score, CAST(0 AS DOUBLE)) AS top_score FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
