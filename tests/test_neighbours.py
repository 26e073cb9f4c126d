"""The nearest concept against all pairs, on odd vectors; and how few clusters are looked into."""

import math
import random

import pytest
from loomgraph.operators import extract, neighbours

SCHEMA = "type string, v array<double>"


def brute(queries, concepts, threshold=-1.0):
    def cosine(a, b):
        a, b = ([] if x is None else x for x in (a, b))
        if len(a) != len(b) or not a or any(x is None or not math.isfinite(x) for x in a + b) or not any(a) or not any(b):
            return 0.0
        x = sum(p * q for p, q in zip(a, b, strict=True)) / math.sqrt(sum(p * p for p in a)) / math.sqrt(sum(q * q for q in b))
        return round(max(-1.0, min(1.0, x)), 6) + 0.0

    out = {}
    for q, t, v in queries:
        met = [(-cosine(v, w), c) for c, u, w in concepts if t is not None and t == u and c != q]
        if met and -min(met)[0] >= threshold:
            out[q] = (min(met)[1], -min(met)[0])
    return out


def odd(n, seed, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(k, rng.choice("AAAAB"), [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for k in range(n)]
    rows += [(n + k, "A", list(rows[3][2])) for k in range(40)]  # a common vector
    rows += [(5000, "A", None), (5001, "A", []), (5002, "A", [0.0] * dim), (5003, "A", [1.0, 2.0]), (5004, "B", [math.nan] * dim), (5005, None, [1.0] * dim), (5006, "C", [-1.0] * dim), (5007, "C", [1.0] * dim), (5008, "D", [1.0]), (5009, "A", [-x for x in rows[3][2]]), (5010, "B", [None] * dim)]
    return rows


@pytest.mark.parametrize("size", [(1 << 14, 1 << 17), (16, 8)])
def test_nearest(spark, monkeypatch, size):
    monkeypatch.setattr(neighbours, "BLOCK", size[0])
    monkeypatch.setattr(neighbours, "PART", size[1])
    rows = odd(300, 1)
    c = spark.createDataFrame(rows, f"c long, {SCHEMA}").repartition(3)
    queries = [r for r in rows if r[0] % 4 == 0 or r[0] >= 300] + [(9000, "A", [1.0] * 6), (9001, "Z", [1.0] * 6), (9002, "C", [0.0] * 6)]
    q = spark.createDataFrame(queries, f"q long, {SCHEMA}").repartition(2)
    for threshold in (-1.0, 0.5):
        got = {r["q"]: (r["nearest"], r["score"]) for r in extract.nearest(q, c, threshold, pivots=6).collect()}
        want = brute(queries, rows, threshold)
        assert set(got) == set(want)
        assert all(got[k] == want[k] for k in want), [(k, got[k], want[k]) for k in want if got[k] != want[k]][:5]
    assert extract.nearest(q.limit(0), c).count() == 0 and extract.nearest(q, c.limit(0)).count() == 0


def test_nearest_looks_into_few_clusters(spark):
    """On clustered vectors most concepts are never compared with a query."""
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(24)]
    rows = [(k, "A", [x + rng.gauss(0, 0.02) for x in rng.choice(centres)]) for k in range(2000)]
    c = spark.createDataFrame(rows, f"c long, {SCHEMA}")
    queries = rows[::40]
    work: list = []
    got = {r["q"]: (r["nearest"], r["score"]) for r in extract.nearest(spark.createDataFrame(queries, f"q long, {SCHEMA}"), c, work=work).collect()}
    assert got == brute(queries, rows)
    home, rest = work
    assert home.count() == len(queries) and rest.count() < 8 * len(queries)  # of 32 pivots' clusters
