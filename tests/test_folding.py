"""Folded comparisons that give places in the source, and lexicons as tables, against plain restatements."""

import random
import unicodedata

import numpy as np
import pytest
from loomgraph.functions import text as T
from loomgraph.operators import extract, lexicon
from pyspark.sql import functions as F

LETTERS = ["a", "B", "s", "S", "ß", "ẞ", "ﬁ", "f", "i", "I", "İ", "ı", "ŉ", "Ａ", "ａ", "１", "1", "é", "é", "Σ", "ς", "K", "k", " ", "-", "日", "́", "ΐ", "😀", "x", "\x01"]


def fold(t, compat):
    return (unicodedata.normalize("NFKC", t) if compat else t).casefold()


def clusters(t, compat):
    """Characters with the marks that follow them (without compat: single characters)."""
    out = []
    for c in t:
        if compat and out and unicodedata.category(c)[0] == "M":
            out[-1] += c
        else:
            out.append(c)
    return out


def brute_span(needle, t, compat):
    f, n = fold(t, compat), fold(needle, compat)
    at = f.find(n)
    if not needle or at < 0:
        return None
    start = end = None
    own = made = 0
    for c in clusters(t, compat):
        k = len(fold(c, compat))
        if start is None and at < made + k:
            start = own
        if end is None and at + len(n) <= made + k:
            end = own + len(c)
        own, made = own + len(c), made + k
    return start, end


def texts(n, seed, most=14):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("compat", [False, True])
def test_spans_in_folded_text(spark, compat):
    given = [(n, t) for n, t in zip(texts(600, 1, 3), texts(600, 2), strict=True) if not any(unicodedata.category(c)[0] == "M" for c in n)]
    given += [("strasse", "Die STRAẞE und die Straße"), ("fi", "oﬁcina"), ("i", "İ"), ("SS", "ß"), ("", "a"), ("a", ""), ("b", "xaB")]
    df = spark.createDataFrame(given, "n string, t string")
    got = df.select("n", "t", T.span_of(F.col("n"), F.col("t"), F.lit(0), compat).alias("x")).collect()
    some = 0
    for r in got:
        want = brute_span(r["n"].replace("\x01", "\x02"), r["t"].replace("\x01", "\x02"), compat)
        assert (tuple(r["x"]) if r["x"] else None) == want, (r, want)
        some += want is not None
    assert some > 40


def brute_mentions(rows, entries, compat):
    out = set()
    for key, t in rows:
        for kind, name, alias in entries:
            if alias and t and (span := brute_span(alias, t, compat)):
                out.add((key, kind, name, alias, *span))
    return out


@pytest.mark.parametrize(("compat", "most"), [(False, 1 << 20), (True, 1 << 20), (True, 2000)])
def test_lexicon_as_a_table(spark, compat, most):
    """Names of 1 to 40 characters, some of them others' beginnings; one block and several."""
    rng = random.Random(7)
    plain = ["ab", "abcdefgh", "abcdefghi", "abcdefghabcdefgh", "abcdefghabcdefghabc", "b", "strasse", "Straße", "fine", "ﬁne", "日本", "日", "", None]
    entries = [("D", f"n{k}", a) for k, a in enumerate(plain)] + [("E", "other", "ab"), ("D", "n0", "ab")]
    entries += [("X", f"x{k}", t) for k, t in enumerate(texts(60, 3, 4)) if not any(unicodedata.category(c)[0] == "M" for c in t)]
    rows = [(k, t) for k, t in enumerate(texts(120, 4, 30))]
    rows += [(900 + k, "".join(rng.choice([p for p in plain if p]) for _ in range(8))) for k in range(30)] + [(1000, None), (1001, ""), (1002, "Die STRASSE abcdefghABCDEFGHabcdefghx")]
    rows = [(k, t and t.replace("\x01", "_")) for k, t in rows]
    lex = spark.createDataFrame(entries, "type string, name string, alias string")
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = extract.dictionary_mentions(docs, lex, "doc_id", compat=compat, most=most)
    assert got.columns == ["doc_id", "type", "name", "alias", "start", "end"]
    found = [tuple(r) for r in got.collect()]
    want = brute_mentions(rows, set(entries), compat)
    assert len(found) == len(want) > 200 and set(found) == want
    assert extract.dictionary_mentions(docs, lex.limit(0), "doc_id").count() == 0 and extract.dictionary_mentions(docs.limit(0), lex, "doc_id").count() == 0


def test_lexicon_is_not_in_the_plan(spark):
    lex = spark.createDataFrame([("D", f"name {k}", f"alias {k}") for k in range(5000)], "type string, name string, alias string")
    docs = spark.createDataFrame([(1, "has ALIAS 4999 and alias 7"), (2, "none")], "doc_id int, text string")
    got = extract.dictionary_mentions(docs, lex, "doc_id")
    assert "alias 4999" not in got._jdf.queryExecution().toString()
    assert sorted((r["doc_id"], r["alias"], r["start"]) for r in got.collect()) == [(1, "alias 4", 4), (1, "alias 49", 4), (1, "alias 499", 4), (1, "alias 4999", 4), (1, "alias 7", 19)]


def test_many_names_cost_one_scan():
    """The time of a scan does not follow the number of names: work is counted, not timed."""
    rng = np.random.default_rng(5)
    names = sorted({bytes(rng.integers(97, 123, rng.integers(9, 24)).astype(np.uint8)) for _ in range(50000)})
    t = lexicon.trie(names)
    looked = []
    plain = lexicon.Table.look
    lexicon.Table.look = lambda self, node, key: (looked.append(len(node)), plain(self, node, key))[1]
    try:
        text = b" ".join(names[k] for k in rng.integers(0, len(names), 2000))
        buf = np.frombuffer(text, np.uint8)
        _, name, start, end = lexicon.occurrences(t, buf, np.array([0, len(buf)]))
    finally:
        lexicon.Table.look = plain
    assert len(name) >= 1900 and all(text[s:e] == names[n] for n, s, e in zip(name, start, end, strict=True))
    assert sum(looked) < 10 * len(buf)  # nine look-ups a place at the first level, few places beyond it
