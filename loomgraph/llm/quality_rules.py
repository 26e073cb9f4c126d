"""Quality rules as a bitmask ledger: every rule is evaluated once, its verdict is one bit.

``ledger`` adds the measurements and ``failed_bits``; ``apply_policy`` turns the bits into a
verdict under a named, versioned policy without reading any text again; ``ablation`` counts,
from the bits alone, what each rule drops and what it alone drops.

Only DataFrame functions are used, all within the row: no shuffle but for the ablation,
which counts (bits) map-side first and so moves at most a row per task and bit pattern.

Defined cases: a null or empty text has no words and fails ``few_words``; null keys and other
columns pass through; repeated rows each get their own, equal result; an empty table gives an
empty ledger; columns of the input whose names clash with those added are replaced.  Very long
texts, and very long runs of one kind of character in them, take time in proportion to their
length and memory of a few times the text: the sort of window hashes runs only where a window
repeats.  Nothing is ranked, so there are no ties.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native_spans import packed, unpacked

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\f\r"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")

#: name -> what fails, over the measurements.  The order is the order of the bits: append only.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "repeated_lines": "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "shouting": "2 * n_capitals > word_chars",
}


@dataclass(frozen=True)
class Policy:
    """A named set of rules; a document is kept if none of them failed."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_words")),
    "v2": Policy("v2", tuple(RULES)),
}


def _measured(df: DataFrame, text: str) -> DataFrame:
    own = packed(df, text, (*MEASURES, "failed_bits"))
    trimmed = F.btrim("_t", F.lit(SPACES))  # looks at each end once, however long a run of blanks stands elsewhere
    own = own.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+")))
    own = own.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    gram = F.transform("_w", lambda w, i: F.xxhash64(w, *[F.get("_w", i + k) for k in range(1, WINDOW)]))
    own = own.withColumn("_g", F.slice(gram, F.lit(1), F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))))
    # (hash, position) sorted, only where some window occurs twice
    own = own.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda e, i: F.coalesce(e.h == F.get("_s", i - 1).h, F.lit(False)) | F.coalesce(e.h == F.get("_s", i + 1).h, F.lit(False)))
    own = own.withColumn("_p", F.sort_array(F.transform(twice, lambda e: e.i)))
    covered = F.transform("_p", lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - v, F.lit(WINDOW))))
    lost = lambda pattern: F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))
    own = own.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": lost("[#*$%&|<>]").cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
            "n_capitals": lost("[A-Z]").cast("long"),
        }
    )
    return own.withColumn("failed_bits", failed_bits())


def failed_bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, fails in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measurements and ``failed_bits`` (bit i: rule i of RULES failed)."""
    return unpacked(_measured(df, text), (*MEASURES, "failed_bits"))


def apply_policy(book: DataFrame, policy: str = "v2", into: str = "kept") -> DataFrame:
    """A ledger with the policy's verdict; reads only ``failed_bits``."""
    return book.withColumn(into, F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy].mask)) == 0)


def ablation(book: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of the policy: rows it fails, and rows that only it fails (kept without it)."""
    counts = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy].mask)).alias("b")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[policy].rules]
    each = counts.withColumn("r", F.explode(F.array(*rules)))
    own = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(
        own(F.col("b").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"), own(F.col("b") == F.col("r.bit")).alias("n_only"), F.sum("n").alias("n_rows")
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    book = apply_policy(ledger(docs), "v2")
    base = F.lit(POLICIES["v1"].mask)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "failed_bits")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT g.doc_id, unnest(range(p, p + 5)) AS q FROM g JOIN twice ON g.doc_id = twice.doc_id AND g.g = twice.g) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN l ON d.doc_id = l.doc_id),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END + CASE WHEN 2 * n_capitals > word_chars THEN 64 ELSE 0 END AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, bits & 3 <> 0 AS base_failed, bits = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits FROM b
"""
