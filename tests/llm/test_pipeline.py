"""The corpus pipeline: its stages change what they should, on the smallest given tables and on odd ones."""

from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from tideline.llm import minhash, quality
from tideline.llm.common import saved

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "stage")
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "mixing to weights", "packing"]
    assert all(df.columns == COLUMNS for df in stages[:-1])
    counts = [df.count() for df in stages]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]


def test_decisions_take_effect(spark, stages):
    _, good, cleaned, unique, mixed, packed = stages
    scored = {r.doc_id: r.predicted for r in quality.classify(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in good.collect()} == {k for k, p in scored.items() if p}
    kept = {r.doc_id for r in minhash.near_classes(cleaned).collect() if r.kept}
    assert {r.doc_id for r in unique.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in packed.collect())


def test_run_agrees_with_the_stages(spark, stages):
    got = pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_stages_take_odd_and_empty_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string"
    rows = [(1, None, None, None, None, "x", "y"), (2, "", "en", "s", 0, "x", "y"), (2, "", "en", "s", 0, "x", "y"), (3, "a b\nc\nd", "en", "s", 7, "x", "y")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == docs.columns and after.count() >= 0
        assert pipeline.STAGES[-1][1](spark, docs, SF).count() == len(data)
