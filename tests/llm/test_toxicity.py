"""Toxicity: held-out accuracy, misspellings, n-grams and gradients against plain ones, odd tables."""

import random
import zlib

import numpy as np
import pytest

from tideline.llm import toxicity

BAD = ["wretchedfool", "stinkingrat", "loathsome", "blockhead", "filthmonger"]


def _tables(spark, n=900):
    draw = random.Random(3)
    stems = ["ba", "co", "di", "fe", "go", "hu", "ki", "la", "me", "no", "pa", "ri", "so", "tu", "ve"]
    docs, labels = [], []
    for k in range(n):
        words = ["".join(draw.choices(stems, k=draw.randint(1, 4))) for _ in range(draw.randint(*((2, 9) if k % 7 == 1 else (30, 90))))]
        toxic = k % 5 == 0 and len(words) > 9
        if toxic:
            for _ in range(4):
                words[draw.randrange(len(words))] = draw.choice(BAD)
        docs.append((k, " ".join(words), "1"))
        labels.append((k, int(toxic)))
    odd = [(n, None, "1"), (n + 1, "", "1"), (n + 2, "x" * 600_000, "1"), (n + 2, "x" * 600_000, "1"), (None, "a b", None), (n + 3, "nothing bad", "1")]
    odd += [(n + 4, "well you wretchedfoool are a blockheads and a l0athsome stinkinrat and a filthmongers " + " ".join(draw.choices(stems, k=30)), "1")]
    docs_df = spark.createDataFrame([*docs, *odd], "doc_id long, text string, score string")
    labels_df = spark.createDataFrame([*[(a, b) for a, b in labels], (0, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    return docs_df, labels_df, dict(labels), n


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels, known, n = _tables(spark)
    rows = toxicity.classify_toxic(docs, labels).collect()
    assert len(rows) == n + 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) / len(held) > 0.97
    by_id = {r.doc_id: r for r in rows}
    assert by_id[n + 4].predicted == 1 and by_id[n + 3].predicted == 0
    assert by_id[n].score == by_id[n + 1].score and len({r.score for r in rows if r.doc_id == n + 2}) == 1


def test_labels_of_the_held_out_fold_change_nothing(spark):
    docs, labels, _, _ = _tables(spark, 200)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    scores = [{(r.doc_id, r.score) for r in toxicity.classify_toxic(docs, t).collect()} for t in (labels, turned)]
    assert scores[0] == scores[1]


def test_no_labels_and_empty_tables(spark):
    docs, labels, _, n = _tables(spark, 20)
    assert {r.score for r in toxicity.classify_toxic(docs, labels.filter("false")).collect()} == {0.5}
    assert toxicity.classify_toxic(docs.filter("false"), labels).collect() == []


def test_grams_are_those_of_each_word():
    def keys(text):
        return toxicity.grams(np.frombuffer(text.encode("utf-32-le"), np.uint32))

    # A word's n-grams depend on the word alone, and each window of 3 to 6 counts once, as does the word.
    for words in (["a"], ["word", "of", "mouth"], ["é", "straße"]):
        apart = sorted(np.concatenate([keys(w) for w in words]).tolist())
        assert sorted(keys("  " + " \n".join(words) + "\t").tolist()) == apart
        assert len(apart) == sum(1 + sum(max(0, len(w) + 3 - k) for k in range(3, 7)) for w in words)
    assert len(keys(" \n ")) == 0 and len(keys("")) == 0


def test_bag_of_a_text_in_pieces(monkeypatch):
    text = " ".join(f"wörd{k % 37}" for k in range(5_000))
    whole = toxicity.bag(text)
    monkeypatch.setattr(toxicity, "PIECE", 101)
    cut = toxicity.bag(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert [a.tolist() for a in toxicity.read(toxicity.written(cut))] == [a.tolist() for a in cut]
    assert toxicity.bag(None)[0].size == 0 and toxicity.bag("y" * 1_000)[0].size > 0


def test_step_follows_the_gradient():
    """A small step lowers the loss as numeric derivatives say."""
    buckets, counts = np.array([3, 9, 77], np.int32), np.array([2, 1, 4], np.float32)
    model = toxicity.Model.fresh(0.3)
    model.vectors = model.vectors.astype(np.float64)

    def loss(vectors, softmax):
        mean = (counts / (counts.sum() + toxicity.PRIOR)) @ vectors[buckets]
        z = softmax @ mean + model.bias
        return float(np.logaddexp(z[0], z[1]) - z[1])

    before, softmax = model.vectors.copy(), model.softmax.copy()
    model.step(buckets, counts, 1.0)
    moved = model.vectors - before
    assert loss(model.vectors, softmax) < loss(before, softmax) and loss(before, model.softmax) < loss(before, softmax)
    assert (np.abs(moved).sum(axis=1) > 0).sum() == 3
    slope = np.zeros_like(moved)
    for b in buckets:
        for k in range(toxicity.SIZE):
            up, down = before.copy(), before.copy()
            up[b, k] += 1e-3
            down[b, k] -= 1e-3
            slope[b, k] = (loss(up, softmax) - loss(down, softmax)) / 2e-3
    for b in buckets:
        assert moved[b] @ slope[b] == pytest.approx(-np.linalg.norm(moved[b]) * np.linalg.norm(slope[b]), rel=1e-3)


def test_logistic_is_the_least_loss():
    points = [(-2.0, 0.1, 30), (0.0, 0.3, 20), (1.5, 0.7, 25), (4.0, 0.9, 10)]
    slope, shift = toxicity.logistic(points)

    def loss(a, c):
        return sum(n * (np.logaddexp(0, a * z + c) - y * (a * z + c)) for z, y, n in points) + ((a - 1) ** 2 + c**2) / 2

    assert all(loss(slope, shift) <= loss(slope + da, shift + dc) for da in (-0.01, 0, 0.01) for dc in (-0.01, 0, 0.01))
    assert toxicity.logistic([]) == (1.0, 0.0)
