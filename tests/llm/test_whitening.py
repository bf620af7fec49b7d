"""Operator 11 against whole-number arithmetic and a dense solver."""

import math

import numpy as np
import pytest

from riskloom.llm import whitening


def expected(rows, wanted=8):
    """n, deviations, eigenvalues, vectors and trace, from all rows at once; sums and deviations in whole numbers."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    far = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    z = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(z.T @ z / n)
    return n, far, values[::-1][:wanted], vectors[:, ::-1][:, :wanted], values.sum(), z


def held(df, rows, wanted=8):
    n, far, values, vectors, trace, z = expected(rows, wanted)
    got = {}
    for r in df.collect():
        got.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(got) == list(range(1, wanted + 1))
    for k, own in got.items():
        assert len(own) == n
        w = np.array([own[i].whitened for i, _ in rows])
        w0 = z @ vectors[:, k - 1] / math.sqrt(values[k - 1])
        assert np.abs(w - w0 * np.sign(w @ w0)).max() < 1e-9
        for (i, _), d in zip(rows, far, strict=True):
            r = own[i]
            assert r.n == n and r.deviation == d and r.identity_error < 1e-9
            assert abs(r.explained - values[k - 1] / trace) < 1e-9


def test_whitening_of_the_corpus(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    held(whitening.query(spark, sf), good)


def test_broken_vectors_and_few_dimensions(spark):
    rng = np.random.default_rng(5)
    good = [(i, (rng.standard_normal(5) * [9, 5, 3, 2, 1]).tolist()) for i in range(60)]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [math.nan] * 5), (103, [1.0, math.inf, 0.0, 0.0, 0.0]), (104, []), (105, [1.0]), (106, [1e300] * 5), (107, [-1e19] * 5)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in good + bad], "vec_id long, embedding array<double>, x string, n int").repartition(5)
    held(whitening.whiten(frame), good, 5)
    held(whitening.whiten(frame, 2), good, 2)


def test_equal_eigenvalues_and_repeated_rows(spark):
    corners = [[a, b, c] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)] * 3
    frame = spark.createDataFrame([(None if k < 3 else k % 4, v) for k, v in enumerate(corners)], "vec_id long, embedding array<double>")
    got = whitening.whiten(frame).collect()
    assert len(got) == 24 * 3 and {r.n for r in got} == {24} and sum(r.vec_id is None for r in got) == 9
    for k in (1, 2, 3):
        w = [r.whitened for r in got if r.component == k]
        assert abs(sum(w)) < 1e-9 and abs(sum(x * x for x in w) / 24 - 1) < 1e-9
        assert abs({r.explained for r in got if r.component == k}.pop() - 1 / 3) < 1e-12


def test_components_without_variance(spark):
    rows = [(k, [float(k), 2.0 * k, 7.0]) for k in range(9)]
    held(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows, 1)
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(1)).count() == 0
    assert whitening.whiten(same.where("false")).collect() == []
    assert whitening.whiten(same.where("false")).columns == whitening.whiten(same).columns


def test_deviations_stay_whole_numbers(spark):
    rows = [(k, [float(2**13 * (k % 7)), float(k)]) for k in range(50)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    far = expected(rows, 2)[1]
    assert got == {i: d if d < 2**63 else None for (i, _), d in zip(rows, far, strict=True)}
    assert None not in got.values()
    wide = [(k, [float(2**40 * (k % 3)), 1.0 * k]) for k in range(9)]
    got = whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {None if d >= 2**63 else d for d in expected(wide, 2)[1]}


@pytest.mark.parametrize("size, ratio", [(1, 0.5), (3, 0.1), (40, 0.97), (200, 0.99)])
def test_solver_against_a_dense_one(size, ratio):
    rng = np.random.default_rng(size)
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    given = 1000 * ratio ** np.arange(size)
    v = (q * given) @ q.T
    calls = []

    def product(u):
        calls.append(u.shape)
        return v @ u

    values, vectors = whitening.leading_pairs(product, size, 8)
    k = min(8, size)
    assert np.abs(values - given[:k]).max() < 1e-10 * given[0]
    assert np.abs(v @ vectors - vectors * values).max() < 1e-10 * given[0]
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12 and max(s[1] for s in calls) <= 12
