"""Two-step paths that are never scored are never chosen."""

import random

import pytest
from loomgraph.operators import retrieve as R


@pytest.mark.parametrize("seed", [1, 2])
def test_promising_hops_lose_no_choice(spark, seed):
    rng = random.Random(seed)
    words = ["red", "blue", "ring", "bolt", "old", "drug", "set"]
    nodes = [(f"n{k}", rng.choice(["Drug", "Drug", "Condition", "Paper"]), rng.choice(["", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(6))])) for k in range(24)] + [("hub", "Condition", "big hub"), ("x", "Drug", None)]
    ends = [n for n, _, _ in nodes]
    edges = [(f"e{k}", rng.choice(["TREATS", "PREVENTS", "ASSOCIATED_WITH", "MENTIONS"]), rng.choice(ends), rng.choice([*ends, "hub", "hub"]), rng.choice([0.9, 0.9, 0.95, None])) for k in range(140)]
    n, e = spark.createDataFrame(nodes, "id string, label string, name string"), spark.createDataFrame(edges, "id string, type string, src string, dst string, confidence double")
    questions = spark.createDataFrame([(1, "which path connects the red ring to blue bolt through a drug"), (2, "what path may treat the old bolt set")], "q int, question string")
    concepts = spark.createDataFrame([(0, "ring blue", ["red ring"]), (1, "bolt", ["old set bolt"]), (2, "set", [])], "c int, name string, aliases array<string>")
    asked = R.analysed(questions)
    groups = R.matched_groups(asked, concepts)
    q = R.kept(R.expanded_terms(asked, groups))
    starts = R.kept(R.anchors(q, n).select("q", "id").join(q.select("q", "types", "wants_path"), "q"))
    work: list = []
    for budget in (2, 4):
        every = R.kept(R.two_hop_paths(starts, e, n))
        few = R.kept(R.promising_hops(starts, e, n, q, groups, budget, work))
        assert few.count() < every.count() and few.exceptAll(every).isEmpty()
        a, b = (sorted(map(tuple, R.packed(R.scored(p, e, n, q, groups), budget).collect())) for p in (every, few))
        assert a == b and a
