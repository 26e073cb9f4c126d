"""The pipeline against its stages restated, and the queries of the subpackage against their SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import corpus_pipeline
from loomgraph.llm import queries, sentencepiece_codec
from test_queries import SF, duck, rows  # noqa: F401

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):  # noqa: F811
    got = queries.queries()[name](spark, SF)
    assert {"doc_id", "anchor_id", "source"} & set(got.columns)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in queries.oracle_sql():
        assert rows(got.toPandas()) == rows(duck.execute(queries.oracle_sql()[name]).df())
    else:
        assert got.count() == n


def test_pipeline(spark, duck):  # noqa: F811
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    near = duck.execute(queries.oracle_sql()["op3_near_dup"]).df()
    dirty = duck.execute(queries.oracle_sql()["op4_decontaminate"]).df()
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    want = letters & set(near[near.kept].doc_id) - set(dirty[dirty.contaminated].doc_id)
    got = out.collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want)
    sp = sentencepiece_codec.agenda(sentencepiece_codec.model_bytes()).sp
    assert all(r["ids"] == sp.encode(r["text"], add_bos=True, add_eos=True) and r["decoded"] == sp.decode(r["ids"]) for r in got)
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF)
        assert step.columns == docs.columns
