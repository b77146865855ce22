"""Stages of the pipeline on rows that clash with the operators' own names, and on repeated ids."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_line_dedup_keeps_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_removed int"
    rows = [(1, "a\nb\nc\nd", "en", "s", 7, "mine", 40), (2, "x\na\nb\nc", "en", "s", 7, None, 41), (3, None, "en", "s", None, "theirs", None)]
    docs = spark.createDataFrame(rows, schema)
    after = pipeline.without_repeated_lines(spark, docs, SF)
    assert after.schema == docs.schema
    assert {(r.doc_id, r.text, r.n_chars, r.n_lines, r.n_removed) for r in after.collect()} == {
        (1, "a\nb\nc\nd", 7, "mine", 40), (2, "x", 1, None, 41), (3, None, None, "theirs", None)
    }


def test_near_dedup_of_repeated_ids(spark):
    rng = random.Random(71)
    one, other, third = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def left(rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
        after = pipeline.one_of_near_duplicates(spark, docs, SF)
        assert after.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in after.collect()), key=str)

    near = other + " more"
    # The smallest id of other's class is 3, one is only in 5; third and near share an id with other texts.
    rows = [(3, other), (5, other), (5, one), (5, one), (5, third), (6, near), (6, third), (None, one)]
    assert left(rows) == sorted([(3, other), (5, one), (5, third), (None, one)], key=str)
    assert left([(3, other), (3, other), (4, one), (7, near)]) == sorted([(3, other), (4, one)], key=str)
