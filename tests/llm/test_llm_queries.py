"""Registered corpus queries and the pipeline on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import corpus as C  # noqa: E402

import corpus_pipeline  # noqa: E402
from blockhist.llm.queries import load  # noqa: E402
from workloads import check  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, problem, _ = check.compare(spark, con, SF, QUERIES[name], SQL.get(name))
    assert problem is None and rows > 0


def test_repeats_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert C.in_order(QUERIES["op2_suffix_array_dedup"](spark, SF).collect()) == C.in_order(C.repeats(docs, 400))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r.text for r in docs.collect()}
        kept[name] = after
        if i < 4:
            assert docs.columns == columns
        assert docs.count() == len(after)
        if name == "language_id":
            assert set(after) >= {d for d, t in before if sum(c.isalpha() for c in t or "") > 50}
        if name == "near_duplicates":
            assert set(after) == {d for d, _, c in C.near_components(before) if d == c or not C.shingles(dict(before)[d])}
        if name == "decontamination":
            assert set(after) == {d for d, *_, dirty in C.contaminated(before, items) if not dirty}
        if name == "personal_data":
            assert set(after) == set(dict(before)) and not any(C.base_spans(t) for t in after.values())
    assert set(kept["source_mix"]) <= set(kept["personal_data"])
    assert corpus_pipeline.run(spark, SF).select("doc_id").distinct().count() == len(kept["source_mix"])


def test_pipeline_on_awkward_rows(spark, tmp_path):
    docs = C.documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
