"""Hard negatives, the byte-level codec and the source audit, each against a plain restatement."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from loomgraph.llm import byte_bpe, hard_negatives, source_divergence
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<double>, label int, a string, i string, v string, cell string"


def brute_negatives(rows, step, positives=5, k=3, low=50, high=95):
    first = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        first[i] = min(first.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(x * 256) for x in v]) for i, (label, v) in first.items()}
    out = set()
    for a, (label, v) in whole.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, (other, w) in whole.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s][:k]
            out |= {(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit, 1)}
    return out


def vectors(scale, n=160, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.gauss(0, scale), scale, 0.0]) for _ in range(4)], rng.choice([1, 1, 2, 3])) for i in range(-20, n)]
    rows += [(i, v, label) for i, v, label in rows[:5]]  # repeated rows
    rows += [(7, [scale] * 4, 0), (8, [scale] * 4, 3), (None, [1.0], 1), (900, None, 1), (901, [1.0, None], 1), (902, [math.nan], 1), (903, [math.inf], 1), (904, [1.0], None)]
    return rows + [(300, [scale], 1), (301, [], 2), (302, [scale] * 6, 2), (310, [scale] * 6, 1)]  # of other lengths


@pytest.mark.parametrize("scale", [1.0, 1e4, 3e5, 1e5])
def test_hard_negatives(spark, monkeypatch, scale):
    """Components for which products are exact in float32, float64 and 64-bit integers; several blocks of anchors and rows."""
    if scale == 1e5:
        monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
        monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 16)
    rows = vectors(scale)
    df = spark.createDataFrame([(*r, *"aivc") for r in rows], VECTORS)
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 10)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) > 30 and set(found) == want


def test_hard_negatives_without_rows(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
    lonely = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(lonely, F.col("vec_id") % 10 == 0).count() == 0  # no positive


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for most in (2**10, 2**24, 2**29):
        a, b = (rng.integers(-most, most, (7, 16)) for _ in range(2))
        assert (hard_negatives.scores(a.astype(float), b.astype(float)) == a @ b.T).all()
    with pytest.raises(OverflowError):
        hard_negatives.scores(np.full((1, 4), 2.0**40), np.full((1, 4), 2.0**40))
    for top in (50, 2**60):  # both ways of sorting
        s = rng.integers(-top, top, (5, 40))
        s[:, ::3] = s[:, :1]
        drop = rng.random(s.shape) < 0.3
        place, best, n = hard_negatives.ordered(s, drop)
        for r in range(5):
            want = sorted((-int(x), p) for p, (x, d) in enumerate(zip(s[r], drop[r], strict=True)) if not d)
            assert [(-int(x), int(p)) for x, p in zip(best[r, : n[r]], place[r, : n[r]], strict=True)] == want


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    tokens = byte_bpe.read_ranks()
    return tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def odd_texts(n=3000, seed=5):
    rng = random.Random(seed)
    parts = ["'", "'s", "'ll", "'re", "'v", "s", "t", "l", "e", "ve", "d", " ", "  ", "\n", "\t", "\r\n", " ", "　", "a", "Z", "é", "ß", "1", "٢", "½", "!", "...", "中文", "😀", "é", "\x00", "​", "\x85", "ſ", "﻿", "<|endoftext|>"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(300)]
    # long runs, among them two of equal length whose bytes have the same sums of powers modulo 2 ** 64
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    return [*out, word, word.translate(str.maketrans("ab", "ba")), " " * 5000, "ab" * 20000, "x" * 30000, "'s" * 999]


def test_byte_bpe(spark, tik):
    texts = [None, "", *odd_texts()]
    given = spark.createDataFrame([(i if i % 50 else None, t, "x", [1], "y") for i, t in enumerate(texts)] * 2, "doc_id long, text string, n_tokens string, ids array<int>, b string")
    want = Counter()
    for i, t in enumerate(texts):
        ids = tik.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        want[(i if i % 50 else None, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 2
    got = byte_bpe.digests(given)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()) == want and "b" in got.columns
    for r in byte_bpe.encoded(given).collect():
        assert r["ids"] == tik.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert byte_bpe.encoded(given.limit(0)).count() == 0 and byte_bpe.encoded(given, decoded=None).columns == [*[c for c in given.columns if c != "ids"], "ids"]


def test_byte_bpe_model(tik):
    """Every token of the vocabulary is a piece of the model, and is made by its merges; decoding inverts encoding."""
    tokens = byte_bpe.read_ranks()
    v = byte_bpe.Vocabulary(tokens, byte_bpe.model_proto(tokens), byte_bpe.classes())
    assert v.sp.get_piece_size() == len(tokens) + 1
    assert v.sp.encode([byte_bpe.mapped(t) for t in tokens]) == [[i] for i in range(len(tokens))]
    rng = random.Random(9)
    units = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    assert v.units(units) == [tik._encode_single_piece(u) for u in units]  # bytes that are no text, too
    ids, offsets = byte_bpe.encode(pa.array(["a b", None, " 'tis"]), v)
    assert v.decode(ids, offsets) == [b"a b", b"", b" 'tis"]


def brute_audit(docs, least, top=10):
    one, kept, count, groups = 10**9, defaultdict(set), Counter(), set()
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    in_docs = defaultdict(Counter)
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in docs]
    for w, (_, lang, s) in zip(words, docs, strict=True):
        groups.add((lang, s))
        in_docs[lang].update(set(w))
        for x in w:
            count[lang, s, x] += 1
            count[lang, None, x] += 1
    for lang, c in in_docs.items():
        kept[lang] = {x for x, n in c.items() if n >= least}
    total = lambda lang, s: sum(count[lang, s, x] for x in kept[lang])
    p = lambda lang, s, x, n: 1 + one * (count[lang, s, x] + 2) // (n + 2 * len(kept[lang]))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    size = {(lang, s): total(lang, s) for lang, s in groups} | {(lang, None): total(lang, None) for lang in kept}
    for lang, s in groups:
        terms = kept[lang]
        pairs = sorted((-sum(f(p(lang, s, x, size[lang, s]), p(lang, o, x, size[lang, o])) for x in terms), o.encode()) for m, o in groups if m == lang and o != s)
        out += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(pairs, 1)]
        own = [(p(lang, s, x, size[lang, s]), p(lang, None, x, size[lang, None]), x) for x in terms if count[lang, s, x]]
        best = sorted((-f(a, b), x.encode()) for a, b, x in own if a > b)[:top]
        out += [(lang, s, "term", x.decode(), -v, r) for r, (v, x) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [128, 3])
def test_source_audit(spark, block):
    rng = random.Random(11)
    words = ["alpha", "Alpha", "BETA", "beta", "gamma", "é", "É", "ſ", "中文", "x1y", "rare", "𝒳", "", "a", "b", "c"]
    docs = []
    for _ in range(400):
        lang, s = rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["s0"] * 6 + [f"s{k}" for k in range(1, 9)] + [None, "é", "𝒳", ""])
        docs.append((rng.choice([" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), "", None, "12 34"]), lang, s))
    docs += [("only one here", "fr", "s0"), (None, "fr", "s1"), ("1", "it", "s1"), (" ".join(["alpha beta"] * 20000), "en", "s3")] + docs[:40]
    df = spark.createDataFrame([(*d, "t", 1, 2, 3, 4, "v") for d in docs], "text string, lang string, source string, term string, n int, g int, a int, b int, value string").repartition(7)
    got = source_divergence.audit(df, least_docs=4, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = sorted(tuple(r) for r in got.collect())
    want = brute_audit(docs, 4)
    assert found == want and {x[2] for x in want} == {"pair", "term"} and any(x[0] == "fr" and x[4] == 0 for x in want)
    assert source_divergence.audit(df.limit(0)).count() == 0


def test_share_is_exact(spark):
    given = [(c, n, v) for c, n, v in [(0, 0, 1), (5, 10, 3), (10**12, 3 * 10**15, 10**9), (9 * 10**15, 9 * 10**15, 10**6), (7, 10**15 + 7, 12345)]]
    df = spark.createDataFrame(given, "c long, n long, v long").select("*", source_divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 2) // (r["n"] + 2 * r["v"]) for r in df.collect())
