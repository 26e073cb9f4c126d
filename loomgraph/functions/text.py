"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

BLANKS = " \t\n\r\x0b\x0c"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, though lambdas in ``use`` mention it for each entry of an array: the optimizer
    copies an expression into the place that mentions it, and within a lambda that is once an entry."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(sizes: Column, block: int = 512) -> Column:
    """For each entry of an array of whole numbers the sum of those before it.

    A fold that appends copies its array for each entry, so that sums run within blocks, and over the blocks' totals.
    """
    step = lambda acc, x: F.struct((acc["n"] + x).alias("n"), F.concat(acc["a"], F.array(acc["n"])).alias("a"))
    running = lambda xs: F.aggregate(xs, F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("a")), step, lambda acc: acc["a"])
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x)
    cut = lambda xs: F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(block)), lambda k: F.slice(xs, k, F.lit(block)))
    joined = lambda bs: F.flatten(F.zip_with(bs, running(F.transform(bs, total)), lambda xs, first: F.transform(running(xs), lambda n: n + first)))
    return bound(F.transform(sizes, lambda x: x.cast("long")), lambda xs: bound(cut(xs), joined))


def clean(c: Column) -> Column:
    """Missing text is "", and outer blanks do not count."""
    return F.coalesce(F.btrim(c.cast("string"), F.lit(BLANKS)), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _icu(name: str, method: str, c: Column) -> Column:
    return F.java_method(F.lit(f"com.ibm.icu.{name}"), F.lit(method), c, F.lit(True))


def case_folded(c: Column) -> Column:
    """Full case folding (ß and ss are one), by the Unicode library that Spark itself collates with.

    ASCII text, for which it is ``lower``, does not leave generated code.
    """
    return F.when(c.rlike(r"[^\x00-\x7F]"), _icu("lang.UCharacter", "foldCase", c)).otherwise(F.lower(c))


#: Letters whose full upper case has several letters, and their capital of one; the others of that kind have none.
CAPITALS = ("\u00df" + "".join(chr(c) for b in (0x1F80, 0x1F90, 0x1FA0) for c in range(b, b + 8)) + "\u1fb3\u1fc3\u1ff3", "\u1e9e" + "".join(chr(c + 8) for b in (0x1F80, 0x1F90, 0x1FA0) for c in range(b, b + 8)) + "\u1fbc\u1fcc\u1ffc")


def initial(c: Column) -> Column:
    """The first character as a capital, one character for one: \u00df gives \u1e9e, not SS; what has no capital of one letter stays."""
    first = F.translate(F.substring(c, 1, 1), *CAPITALS)
    return F.when(F.length(F.upper(first)) > 1, first).otherwise(F.upper(first))


def folded(c: Column) -> Column:
    """Full case folding of the composed compatibility form: full-width letters and ligatures are plain ones."""
    full = _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "compose", c))
    return F.when(c.rlike(r"[^\x00-\x7F]"), full).otherwise(F.lower(c))


def normalize_term(c: Column) -> Column:
    """Folded (compatibility forms and case), punctuation to blanks, runs of blanks, hyphens and underscores to one blank."""
    t = F.regexp_replace(folded(F.coalesce(c, F.lit(""))), "[‐‑–]", "-")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f-]", " "), r"(?U)[-_\s\x1c-\x1f]+", " "))


def source_span(text: Column, at: Column, n: Column, compat: bool = False) -> Column:
    """(start, end) in ``text`` of ``n`` characters from ``at`` on in its folded form (``folded`` with ``compat``, else
    ``case_folded``); what one character (with ``compat``: and its marks) folds to is never cut.

    The text falls into runs of ASCII and single characters (with their marks), which fold apart.  One fold over their lengths
    finds both places.  U+0001 stands between them, so one in the text counts as U+0002.
    """
    clean_text = F.translate(text, "\x01", "\x02")
    apart = r"(?s)[\x00-\x7F]+(?=[\x00-\x7F]|\z)|\X" if compat else r"(?s)[\x00-\x7F]+|[^\x00-\x7F]"
    tokens = F.regexp_extract_all(clean_text, F.lit(apart), F.lit(0))
    made = F.split((folded if compat else case_folded)(F.array_join(tokens, "\x01")), "\x01")
    pairs = F.zip_with(tokens, made, lambda a, b: F.struct(F.length(a).alias("own"), F.length(b).alias("made"), a.rlike(r"\A[\x00-\x7F]*\z").alias("plain")))
    nothing = F.lit(None).cast("int")
    to = at + n

    def step(acc: Column, x: Column) -> Column:
        plain = x["plain"]
        start = F.when(at < acc["f"] + x["made"], acc["s"] + F.when(plain, at - acc["f"]).otherwise(0))
        end = F.when(to <= acc["f"] + x["made"], acc["s"] + F.when(plain, to - acc["f"]).otherwise(x["own"]))
        return F.struct((acc["s"] + x["own"]).alias("s"), (acc["f"] + x["made"]).alias("f"), F.coalesce(acc["start"], start).alias("start"), F.coalesce(acc["end"], end).alias("end"))

    first = F.struct(F.lit(0).alias("s"), F.lit(0).alias("f"), nothing.alias("start"), nothing.alias("end"))
    found = F.aggregate(pairs, first, step, lambda acc: F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
    return F.when(text.rlike(r"[^\x00-\x7F]"), found).otherwise(F.struct(at.alias("start"), to.alias("end")))


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits; everything else is one underscore between them."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def title_slug(c: Column) -> Column:
    """As ``slug`` with hyphens, 40 characters at most, never empty."""
    s = F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(s, 1, 40), F.lit("")), F.lit("document"))


def light(c: Column) -> Column:
    """Case-folded, underscores to blanks, single blanks."""
    return F.btrim(F.regexp_replace(F.replace(case_folded(clean(c)), F.lit("_"), F.lit(" ")), r"(?U)\s+", " "))


def paper_id(c: Column, where: Column | None = None) -> Column:
    """Upper case with PMC before the digits; anything else raises, with the place ``where`` it stands if that is given."""
    u = F.upper(F.btrim(c))
    full = F.when(u.startswith("PMC"), u).otherwise(F.concat(F.lit("PMC"), u))
    told = F.concat(F.lit("not a PMC id: "), F.coalesce(c, F.lit("null")))
    return F.when(full.rlike(r"\APMC[0-9]+\z"), full).otherwise(F.raise_error(told if where is None else F.concat(where, F.lit(": "), told)))


def key_of(prefix: str, *parts: Column, cut: int | None = None) -> Column:
    """prefix + SHA-1 of the parts joined by "|"; a missing part counts as ""."""
    h = F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit(prefix), F.substring(h, 1, cut) if cut else h)


def entity_id(type_: Column, name: Column) -> Column:
    """Lower-case type, a colon and the name's slug."""
    return F.concat(F.lower(type_), F.lit(":"), slug(name))


def text_document_key(title: Column, text: Column) -> Column:
    """TEXT and the first 12 hex digits of the SHA-1 of title, line end, text."""
    return F.concat(F.lit("TEXT"), F.upper(F.substring(F.sha1(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))), 1, 12)))


def first_of(*cs: Column) -> Column:
    """The first that is neither null nor empty, else ""."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def authors(c: Column) -> Column:
    """Names split at semicolons if there are any, else at commas."""
    parts = F.split(F.coalesce(c, F.lit("")), F.when(F.contains(c, F.lit(";")), F.lit(";")).otherwise(F.lit(",")))
    return F.filter(F.transform(parts, lambda x: F.btrim(x)), lambda x: x != "")


def parts(c: Column) -> Column:
    """The non-empty parts between semicolons."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def canonical(c: Column, allowed: list[str]) -> Column:
    """The allowed value that is equal but for case, else the trimmed value itself."""
    raw = clean(c)
    out = F.lit(None).cast("string")
    for a in allowed:
        out = F.coalesce(out, F.when(F.lower(raw) == a.lower(), F.lit(a)))
    return F.coalesce(out, raw)


def has_any(text: Column, cues: list[str]) -> Column:
    """Whether the text contains any of the cues."""
    if not cues:
        return F.lit(False)
    out = F.contains(text, F.lit(cues[0]))
    for c in cues[1:]:
        out = out | F.contains(text, F.lit(c))
    return out


def negated(c: Column) -> Column:
    """Whether the sentence holds a negation cue."""
    return c.rlike(r"(?iU)\b(no|not|without|neither|failed to|did not|wasn't|were not)\b")


def intent(question: Column) -> Column:
    """The relationship types that a normalised question asks for; the first matching intent counts."""
    out = F.array().cast("array<string>")
    for cues, types in reversed(dims.INTENTS):
        out = F.when(has_any(question, cues), F.array(*[F.lit(t) for t in types])).otherwise(out)
    return out


def path_requested(question: Column) -> Column:
    return has_any(question, dims.PATH_CUES)


def relevance(type_: Column, question: Column) -> Column:
    """1.0 if the normalised question has a cue of the relationship type."""
    out = F.lit(0.0)
    for name, cues in dims.RELEVANCE_CUES.items():
        out = F.when((F.upper(type_) == name) & has_any(question, cues), 1.0).otherwise(out)
    return out


def question_terms(normalized: Column) -> Column:
    """Distinct words of three characters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalized, " "), lambda x: F.length(x) >= 3)))


def without_stop_terms(terms: Column, stop: Sequence[str] = dims.STOP_TERMS) -> Column:
    return F.array_except(terms, F.array(*[F.lit(t) for t in stop]).cast("array<string>"))


def phrase_in(phrase: Column, text: Column) -> Column:
    """Whether a normalised phrase stands in a normalised text as whole words."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def overlap(terms: Column, text: Column) -> Column:
    """Share of the terms (six at most count) that the normalised text contains, 1.0 at most."""
    hits = bound(text, lambda x: F.size(F.filter(terms, lambda t: (F.length(t) >= 3) & F.contains(x, t))))
    return F.when((F.size(terms) == 0) | (text == ""), 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.least(F.size(terms), F.lit(6)))))


def fact_matches(fact: Column, text: Column) -> Column:
    """A normalised fact is in a normalised text, or all its words that count are."""
    words = F.array_except(F.split(fact, " "), F.array(*[F.lit(w) for w in [*dims.FACT_STOPWORDS, ""]]))
    return F.contains(text, fact) | ((F.size(words) > 0) & (F.size(F.array_except(words, F.split(text, " "))) == 0))


def evidence_supported(evidence: Column, chunk: Column, start: Column, end: Column, chunk_start: Column) -> Column:
    """The evidence stands in the chunk (case apart), or is the slice that its offsets name."""
    s, e = start.try_cast("long"), end.try_cast("long")
    base = F.coalesce(chunk_start.try_cast("long"), F.lit(0))
    lo, hi = s - base, e - base
    inside = (lo >= 0) & (hi >= lo) & (hi <= F.length(chunk))
    same = case_folded(F.substr(chunk, (lo + 1).cast("int"), (hi - lo).cast("int"))) == case_folded(evidence)
    return (evidence != "") & (chunk != "") & (F.contains(case_folded(chunk), case_folded(evidence)) | F.coalesce(inside & same, F.lit(False)))


def span_of(needle: Column, text: Column, base: Column, compat: bool = False) -> Column:
    """(start, end) of the first occurrence, case apart, moved by ``base``; null if there is none.  The offsets are those in
    the source text, also where folding lengthens it."""
    fold = folded if compat else case_folded
    at = F.instr(fold(text), fold(needle)) - 1
    span = source_span(text, at, F.length(fold(needle)), compat)
    return F.when((F.length(needle) > 0) & (at >= 0), F.struct((span["start"] + base).alias("start"), (span["end"] + base).alias("end")))


def sentence(type_: Column, source: Column, target: Column) -> Column:
    """A relation as an English sentence."""
    fill = lambda t: F.replace(F.replace(F.replace(F.lit(t), F.lit("{s}"), source), F.lit("{t}"), target), F.lit("{r}"), type_)
    out = fill(dims.SENTENCES[-1][1])
    for types, template in dims.SENTENCES[:-1]:
        out = F.when(type_.isin(types), fill(template)).otherwise(out)
    return out


def join_names(names: Column) -> Column:
    """"a", "a and b", "a, b, and c"."""
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).when(n == 2, F.array_join(names, " and ")).otherwise(
        F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(names, -1))
    )


def answer_mentions(answer: Column, source: Column, type_: Column, target: Column) -> Column:
    """A normalised answer names both ends and states the relation."""
    plain = F.contains(answer, normalize_term(type_))
    for name, cues in dims.ANSWER_CUES.items():
        plain = F.when(F.upper(type_) == name, has_any(answer, cues)).otherwise(plain)
    s, t = normalize_term(source), normalize_term(target)
    return (s != "") & (t != "") & F.contains(answer, s) & F.contains(answer, t) & plain


def byte_size(n: Column) -> Column:
    """Bytes as B, or as KB or MB (of 1,024) with one decimal."""
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / 1024.0, 1))).otherwise(F.format_string("%.1f MB", F.bround(n / 1024.0**2, 1)))


def evidence_kind(reason: Column, text: Column) -> Column:
    """Kind of a rejected candidate by the words of its reason and text."""
    r = F.lower(F.concat_ws(" ", F.coalesce(reason, F.lit("")), F.coalesce(text, F.lit(""))))
    return F.when(F.contains(r, F.lit("relationship")), "relationship").when(has_any(r, ["entity", "gliner"]), "entity").otherwise("other")


def as_text(c: Column, kind: str) -> Column:
    """A value as text: arrays joined by "; ", maps as JSON with sorted keys, null as ""."""
    if kind.startswith("array"):
        return F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), "; "), F.lit(""))
    if kind.startswith("map"):
        return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))
