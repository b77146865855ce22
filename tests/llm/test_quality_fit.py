"""The quality fit against plain ones: features against the kernel, summed normal equations, isotonic steps; odd tables."""

import random
import zlib

import numpy as np

from tideline.llm import quality

#: A good document that the fit sees, labelled 1 and 0.
TWICE = next(k for k in range(1, 200) if k % 3 and zlib.crc32(str(k).encode()) % 4 < 2)


def test_features_approach_the_gaussian_kernel():
    rng = np.random.default_rng(3)
    size, cosines = len(quality.STATISTICS), 40_000
    x = rng.normal(0, 1, (12, size))
    model = quality.Model(
        np.zeros(size), np.ones(size), rng.normal(0, 1 / np.sqrt(size), (size, cosines)), rng.uniform(0, 2 * np.pi, cosines),
        np.zeros(cosines + 1), np.zeros(1), np.zeros(1))
    phi = model.cosines(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * size))
    assert np.abs(phi @ phi.T - kernel).max() < 0.03


def _tables(spark, n=240):
    draw = random.Random(4)
    docs, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        words = ["".join(draw.choices("abcdefgh" if good else "#$%XYZ9", k=draw.randint(2, 9))) for _ in range(draw.randint(5, 60))]
        docs.append((k, " ".join(words), "junk"))
        labels.append((k, int(good)))
    docs += [(n, None, "a"), (n + 1, "", "b"), (3, docs[3][1], "c"), (None, "no id", "d")]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"),
            spark.createDataFrame([*labels, (4, None), (None, 1), (TWICE, 0)], "doc_id long, quality int"))


def test_summed_normal_equations_are_the_ridge_solution(spark):
    docs, labels = _tables(spark)
    model = quality.fit(docs, labels, cosines=24)
    rows = quality.labelled_rows(docs, labels).filter("fold < 2").collect()
    x, y = np.array([r.stats for r in rows]), np.array([r.label for r in rows])
    phi = model.cosines(x)
    weights = np.linalg.lstsq(np.vstack([phi, np.sqrt(quality.PENALTY) * np.eye(25)]), np.concatenate([y, np.zeros(25)]), rcond=None)[0]
    assert np.allclose(model.weights, weights, atol=1e-8)
    assert 0.5 in {r.label for r in quality.labelled_rows(docs, labels).collect()}  # labelled 0 and 1


def test_isotonic_is_the_least_squares_fit():
    draw = random.Random(6)
    for _ in range(60):
        points = [(i / 7 + draw.random() / 9, draw.random(), draw.randint(1, 9)) for i in range(draw.randint(1, 12))]
        total = sum(n for _, _, n in points)
        prior = sum(y * n for _, y, n in points) / total
        y, n = np.array([(y * n + prior) / (n + 1) for _, y, n in points]), np.array([n + 1 for _, _, n in points])

        def mean(j, k):
            return float(y[j:k + 1] @ n[j:k + 1] / n[j:k + 1].sum())

        # The fit at each point is the largest over starts of the least over ends of the block means.
        want = [max(min(mean(j, k) for k in range(i, len(y))) for j in range(i + 1)) for i in range(len(y))]
        x, values = quality.isotonic(points)
        assert np.allclose(sorted(set(np.round(want, 9))), sorted(set(np.round(values, 9)))) and (np.diff(values) >= 0).all() and (np.diff(x) > 0).all()


def test_repeated_rows_empty_texts_and_empty_tables(spark):
    docs, labels = _tables(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert len(by_id[3]) == 2 and by_id[3][0] == by_id[3][1] and by_id[240] == by_id[241]
    assert quality.classify(docs.filter("false"), labels).collect() == []
    assert {r.score for r in quality.classify(docs, labels.filter("false")).collect()} == {0.5}
