"""Texts made to collide or to be dear: equal power sums, very many matches, repeats of one key."""

import time

import pyarrow as pa
import pytest
from loomgraph.llm import language_id, minhash, near_dup, pii, scan, secrets_scan, sentencepiece_codec
from loomgraph.llm.native_spans import scanned
from pyspark.sql import functions as F


def thue_morse(n):
    """Two words over two letters whose sums of powers of an odd number modulo 2 ** 64 are equal from 1,024 letters on."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_equal_power_sums(spark, n):
    one, two = thue_morse(n)
    a = sentencepiece_codec.agenda(sentencepiece_codec.model_bytes())
    for verify in ("units", "texts"):
        ids, offsets = sentencepiece_codec.encode([one, two, one], a, verify)
        got = [ids[s:e].tolist() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == [a.sp.encode(t, add_bos=True, add_eos=True) for t in (one, two, one)] and got[0] != got[1]
    value, other, first = minhash.described_sets(pa.array([one, two, one]))
    assert value[0] == value[2] != value[1] and other[0] == other[2] != other[1]
    buf, starts, lengths, _ = language_id._runs(pa.array([one, two, one]))
    first_of, of = language_id._distinct(buf, starts, lengths)
    assert len(first_of) == 2 and of.tolist()[0] == of.tolist()[2] != of.tolist()[1]
    if n == 1024:
        docs = spark.createDataFrame([(1, one), (2, two), (3, one), (4, f"{one} b c d"), (5, f"{two} b c d")], "doc_id long, text string").repartition(2)
        assert {tuple(r)[::2] for r in near_dup.near_duplicates(docs).collect()} == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)}
        assert all(r["decoded"] == r["text"] for r in sentencepiece_codec.encoded(docs).collect())


def test_distinct_and_digests():
    import numpy as np

    raw = np.frombuffer(b"ab ab  abc  ab c", np.uint8)
    starts, ends = scan.spans(raw, np.array([0, 7, len(raw)]), scan.NOT_SPACE)
    one, of = scan.distinct(raw, starts, ends)
    assert one.tolist() == [0, 2, 4] and of.tolist() == [0, 0, 1, 0, 2]
    d = scan.digests(raw, starts, ends)
    assert (d[0] == d[1]).all() and (d[0] == d[3]).all() and len({tuple(x) for x in d.tolist()}) == 3
    one, of = scan.distinct(np.array([5, 6, 5, 6, 7], np.uint32), np.array([0, 2, 4]), np.array([2, 4, 5]))  # without gaps
    assert of.tolist() == [0, 0, 1]
    assert [len(x) for x in scan.distinct(raw, starts[:0], ends[:0])] == [0, 0]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70000])
def test_scanned(spark, n):
    values = [(7 * i) % 1000 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    got = df.select(scanned(F.col("v"), F.lit(0), lambda a, x: a + x).alias("s"), scanned(F.col("v"), F.lit(3), lambda a, x: F.greatest(a, x)).alias("m")).first()
    sums, most = [0], [3]
    for x in values:
        sums.append(sums[-1] + x)
        most.append(max(most[-1], x))
    assert got["s"] == sums[:-1] and got["m"] == most[:-1]


MANY = {
    "mail": "a@b.c ",
    "numbers": "+1 555 123 4567, 4111 1111 1111 1111 x ",
    "keys": "secret=abcdefgh1234567 " + "Zk3" * 8 + "9q ",
    "addresses": "10.0.0.1 é ",
}


@pytest.mark.parametrize("name", sorted(MANY))
def test_very_many_matches(spark, name):
    """A megabyte of matches: time in proportion to the text (in 256 KB pieces it takes as long in all)."""
    unit = MANY[name]
    text = unit * (1_000_000 // len(unit))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for f, small in ((pii.with_spans, "pii"), (secrets_scan.with_spans, "secrets"), (pii.redact, None)):
        want = f(spark.createDataFrame([(1, unit * 3)], "doc_id long, text string")).first()
        began = time.perf_counter()
        got = f(df).first()
        assert time.perf_counter() - began < 20 * 2  # half of it is room for a busy machine
        n = len(text) // len(unit)
        if small:
            per = [(x["start"], x["end"], x["kind"]) for x in want[small] if x["start"] < len(unit)]
            spans = [(x["start"], x["end"], x["kind"]) for x in got[small]]
            assert len(spans) == n * len(per) and spans[: len(per)] == per
            assert all(text[x["start"] : x["end"]] == x["s"] for x in got[small][-50:])
        else:
            once = want["text"]
            assert len(once) % 3 == 0 and got["text"] == once[: len(once) // 3] * n


def test_overlaps_of_added_secrets(spark):
    """A candidate that overlaps a base span before or after its start is none; others stay."""
    key = "Zk3Qw9" * 5
    texts = [key, f"token={key}", f"{key} AKIA{'B' * 20}", f"AKIA{'B' * 20}{key}", f"{key} token=abcdefgh1 {key}", f"x/{'0a' * 20}Z {key}", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets_scan.with_spans(df).collect():
        base = [(s["start"], s["end"]) for s in r["secrets"] if s["kind"] < 3]
        added = [(s["start"], s["end"]) for s in r["secrets"] if s["kind"] == 3]
        assert not any(s < b[1] and b[0] < e for s, e in added for b in base)
        assert len(added) == [1, 0, 1, 0, 2, 1, 0][r["doc_id"]], (r, added)


def test_redaction_of_overlapping_spans(spark):
    texts = ["+1 (555) 10.20.30.40 x", "a 4111 1111 1111 1111 b é a@b.org", "a@1.2.3.4 c", "none", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["pii"] for r in pii.with_spans(df).collect()}
    for r in pii.redact(df).collect():
        t, at, out = texts[r["doc_id"]], 0, ""
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += t[at : s["start"]] + f"[{pii.KINDS[s['kind']].upper()}]"
            at = max(at, s["end"])
        assert (r["text"] or "") == (out + (t or "")[at:])
