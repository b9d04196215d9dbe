"""Whitening against a dense eigendecomposition, exact sums and defined edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from strandline.llm import queries, whitening
from strandline.llm.whitening import Fit, grams, next_factor, usable

SF = "/root/testdata/sf0.001"


def table(spark, vectors, ids=None):
    rows = [(i, v, "x") for i, v in zip(ids if ids is not None else range(len(vectors)), vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")


def dense(vectors):
    x = [[math.floor(Fraction(c) * 64) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums, strict=True)] for row in x])
    return centred, centred.T @ centred / n, deviation


def check(found, vectors, ids, components):
    centred, cov, deviation = dense(vectors)
    values = np.linalg.eigvalsh(cov)[::-1]
    wide = np.zeros((len(vectors), components))
    place = {i: k for k, i in enumerate(ids)}
    assert len(found) == len(vectors) * components
    for r in found:
        k = place[r.vec_id]
        assert r.n == len(vectors) and r.deviation == (deviation[k] if deviation[k] < 2**63 else None)
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        assert r.identity_error <= 1e-4
        wide[k, r.component - 1] = r.whitened
    assert np.abs(wide.T @ wide / len(vectors) - np.eye(components)).max() < 1e-6
    # Each column is the projection on one unit eigenvector: covariance with the rows gives it back.
    axes = centred.T @ wide / len(vectors) / np.sqrt(values[:components])
    assert np.allclose(np.linalg.norm(axes, axis=0), 1, atol=1e-8)
    assert np.allclose(cov @ axes, axes * values[:components], atol=1e-8 * values[0])


def test_query_agrees_with_dense_eigenvectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(queries.op11_whitening(spark, SF).collect(), [r.embedding for r in rows], [r.vec_id for r in rows], 32)


def test_ill_conditioned_rows_need_further_passes(spark):
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    base = rng.standard_normal((300, 6)) * np.array([1e3, 1e2, 1e2, 10, 1, 1]) @ turn
    check(whitening.whiten(table(spark, base.tolist())).collect(), base.tolist(), range(300), 6)
    worse = usable(table(spark, (rng.standard_normal((300, 6)) * np.array([1e6, 1e4, 1e2, 10, 1, 1]) @ turn).tolist()))
    fits = whitening.fit_whitening(worse)
    assert len(fits[6].factors) >= 3 and fits[6].identity_error < 1e-6
    assert np.abs(grams(worse, fits, Fit.solved)[6] - np.eye(6)).max() < 1e-12


def test_dependent_dimensions_and_few_vectors_keep_their_rank(spark):
    rng = np.random.default_rng(2)
    free = rng.integers(-50, 50, (40, 3)) / 64
    dependent = np.hstack([free, 2 * free[:, :1], np.full((40, 1), 0.25)])
    found = whitening.whiten(table(spark, dependent.tolist())).collect()
    assert {r.component for r in found} == {1, 2, 3} and max(r.identity_error for r in found) < 1e-6
    few = rng.standard_normal((5, 12))
    found = whitening.whiten(table(spark, few.tolist())).collect()
    assert {r.component for r in found} == {1, 2, 3, 4} and max(r.identity_error for r in found) < 1e-6


def test_rows_left_out_repeats_and_lengths(spark):
    good = [[0.5, 0.25], [1.0, -0.5], [0.125, 0.75], [0.125, 0.75]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    other = [[1.0, 2.0, 3.0], [2.0, 0.0, 1.0], [0.0, 1.0, 5.0], [3.0, 3.0, 1.0]]
    df = table(spark, good + bad + other, [1, 2, 3, 3, 4, 5, 6, 7, 8, None, 11, 12, 13])
    found = whitening.whiten(df).collect()
    first = [r for r in found if r.vec_id in (1, 2, 3)]
    assert len(first) == 8 and {r.n for r in found} == {4} and not {r.vec_id for r in found} & {4, 5, 6, 7, 8}
    assert {r.component for r in found if r.vec_id is None} == {1, 2, 3}
    assert {r.component for r in first} == {1, 2}
    assert "n" in found[0].asDict() and found[0].n == 4


def test_no_variance_no_rows(spark):
    assert whitening.whiten(table(spark, [[1.0, 2.0]] * 7)).collect() == []
    assert whitening.whiten(table(spark, [[1.0, 2.0]])).collect() == []
    assert whitening.whiten(table(spark, [])).collect() == []


def test_entries_far_beyond_the_grid(spark):
    found = whitening.whiten(table(spark, [[1e200, 1.0], [-1e200, 2.0], [0.0, 7.5]])).collect()
    assert {r.vec_id for r in found} == {0, 1, 2} and {r.deviation for r in found if r.vec_id < 2} == {None}
    middle = whitening.whiten(table(spark, [[3e12, 1.0], [-3e12, 2.0], [0.0, 7.5]])).collect()
    assert all(np.isfinite(r.whitened) for r in found + middle)


def test_factor_of_a_singular_matrix_is_shifted():
    fit = Fit(10, [0, 0], 1)
    next_factor(fit, np.array([[4.0, 4.0], [4.0, 4.0]]))
    assert np.isfinite(fit.factors[0]).all() and not fit.done
