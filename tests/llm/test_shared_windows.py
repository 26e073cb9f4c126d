"""Benchmark items that share a prompt: right items, and room for their set alone."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from loomgraph.llm import decontaminate, scan
from loomgraph.llm.decontaminate import N


def _found(items, texts):
    index = decontaminate.build(items)
    buf, offsets = scan.texts_of(pa.array(texts, pa.large_string()))
    _, _, first, flag, (of, which) = decontaminate.hits(index, scan.LOWER[buf], offsets)
    cut = np.searchsorted(of, np.arange(len(first)))
    return [index.named(which[a:b]) if b > a else [] for a, b in zip(cut[:-1], cut[1:], strict=True)], index


def test_items_of_texts_equal_a_plain_search():
    rng = random.Random(5)
    prompts = [" ".join(f"p{k}w{j}" for j in range(20)) for k in range(4)]
    items = []
    for k in range(60):
        own = " ".join(f"i{k}w{j}" for j in range(rng.choice([0, 3, 15, 30])))
        items.append((f"item{k}", " ".join([*rng.sample(prompts, rng.randint(0, 2)), own]).strip()))
    items += [("short1", "just four words here"), ("short2", "just four words here"), ("short1", "just four words here"), ("none", ""), (None, prompts[0])]
    texts = []
    for _ in range(200):
        parts = [*rng.sample(prompts, rng.randint(0, 2)), *[t for _, t in rng.sample(items, rng.randint(0, 3))], "x " * rng.randint(0, 5)]
        rng.shuffle(parts)
        words = " ".join(parts).split()
        texts.append(" ".join(words[rng.randint(0, 6) :]))
    grams = {}
    for i, t in items:
        w = t.split()
        n = min(N, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[p : p + n]), set()).add(i or "")
    sizes = {len(g) for g in grams}
    want = []
    for t in texts:
        w = t.split()
        want.append(sorted(set().union(*(grams.get(tuple(w[p : p + n]), ()) for n in sizes for p in range(len(w) - n + 1)))))
    assert _found(items, texts)[0] == want
    assert sum(map(len, want)) > 1000


def test_a_prompt_of_many_items_takes_the_room_of_one_set():
    prompt = " ".join(f"word{j}" for j in range(30))
    items = [(f"item{k}", f"{prompt} own{k} " + " ".join(f"t{k}x{j}" for j in range(5))) for k in range(1000)]
    texts = [f"{prompt} text {k}" for k in range(4000)]
    tracemalloc.start()
    found, index = _found(items, texts[:1])
    assert len(index.items) < 3 * len(items) and found == [sorted(i for i, _ in items)]
    buf, offsets = scan.texts_of(pa.array(texts, pa.large_string()))
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    *_, (of, which) = decontaminate.hits(index, scan.LOWER[buf], offsets)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert len(of) == 4000 and len(set(which.tolist())) == 1
    assert peak < 300 << 20


def test_several_blocks_name_the_same_items(spark):
    prompt = " ".join(f"word{j}" for j in range(30))
    items = spark.createDataFrame([(f"item{k}", f"{prompt} own{k}") for k in range(300)], "item_id string, text string")
    docs = spark.createDataFrame([(k, f"{prompt} text" if k % 2 else f"clean text {k}") for k in range(40)], "doc_id long, text string")
    one = sorted(decontaminate.find(docs, items).collect())
    assert [r["n_items"] for r in one] == [300 * (k % 2) for k in range(40)]
    assert sorted(decontaminate.find(docs, items, most=20_000).collect()) == one
    assert decontaminate.remove(docs, items).count() == decontaminate.remove(docs, items, most=20_000).count() == 20
