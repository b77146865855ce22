"""Whitening against numpy on the same whole numbers, and odd tables."""

from fractions import Fraction

import numpy as np
import pytest

from tideline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, deviation string, whitened int, n string"


def _table(spark, vectors):
    return spark.createDataFrame([(k, v, "kept", 7, "x") for k, v in enumerate(vectors)], SCHEMA)


def _expected(vectors):
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    cov = np.cov((x - total / n).T, bias=True).reshape(x.shape[1], -1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    return ((n * x - total) ** 2).sum(axis=1), values[order], (x - total / n) @ vectors[:, order] / np.sqrt(values[order]), cov


def test_like_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(0, 1, (300, 40)) @ rng.normal(0, 1, (40, 40))).astype(np.float32)
    vectors[100:200] = vectors[0]
    bad = [None, [None] * 40, [float("nan")] + [0.0] * 39, [float("inf")] * 40, [1e300] * 40, [1.0] * 39, []]
    rows = whitening.whiten_embeddings(_table(spark, [v.tolist() for v in vectors] + bad)).toPandas()
    deviation, values, white, _ = _expected(vectors)
    assert len(rows) == 300 * 32 and set(rows.component) == set(range(1, 33)) and set(rows.n) == {300}
    assert list(rows.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = rows[rows.component == 1].sort_values("vec_id")
    assert one.deviation.tolist() == deviation.tolist()
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.abs(got) - np.abs(white[:, :32])).max() < 1e-6
    signs = np.sign(got * white[:, :32])
    assert (signs[:, np.abs(got).min(axis=0) > 1e-9] == signs[0, np.abs(got).min(axis=0) > 1e-9]).all()
    shares = rows.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(shares, values[:32] / values.sum(), rtol=1e-9)
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-9


def test_polarised_sums_are_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(10**6, 10**6 + 10**5, (50, 4))
    n, total = len(x), [int(v) for v in x.sum(axis=0)]
    floors, rests = zip(*(divmod(t, n) for t in total), strict=True)
    parts = whitening.squares(x - np.array(floors))
    raw = {(i, k): int(v) for i, line in enumerate(parts) for k, v in enumerate(line)}
    got = whitening.covariance(n, list(rests), raw)
    for i in range(4):
        for j in range(4):
            exact = sum((Fraction(int(r[i])) - Fraction(total[i], n)) * (Fraction(int(r[j])) - Fraction(total[j], n)) for r in x) / n
            assert got[i, j] == float(exact)


def test_squares_beyond_a_long():
    z = np.array([[1 << 40, -(1 << 40)], [3, 5]])
    assert [[int(v) for v in line] for line in whitening.squares(z)] == [[(1 << 80) + 9, 64], [(1 << 80) + 25]]


@pytest.mark.parametrize("vectors", [[], [None], [[]], [[None, 1.0]]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whiten_embeddings(_table(spark, vectors)).collect() == []


def test_no_variance(spark):
    equal = whitening.whiten_embeddings(_table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(equal) == 6 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in equal} == {(0, None, 0.0, 0.0)}
    line = whitening.whiten_embeddings(_table(spark, [[float(i), 0.0] for i in range(4)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and all(r.identity_error < 1e-12 for r in line)


def test_repeated_rows_and_ids_count(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [2.0, 5.0]), (None, [4.0, 1.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten_embeddings(rows).collect()
    assert len(got) == 8 and {r.n for r in got} == {4} and sum(r.vec_id is None for r in got) == 2


def test_columns_pass_through(spark):
    table = _table(spark, [[0.0, 1.0], [3.0, 5.0], [1.0, 1.0]])
    got = whitening.whiten(table, whitening.fit(table))
    assert got.columns == ["vec_id", "n", "deviation", "whitened"]
    assert {(r.vec_id, r.n, len(r.whitened)) for r in got.collect()} == {(0, "x", 2), (1, "x", 2), (2, "x", 2)}
