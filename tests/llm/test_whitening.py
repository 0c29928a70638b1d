"""Whitening against a dense decomposition of the same whole numbers."""

import numpy as np
import pytest

from clientele.llm.whitening import bidiagonalise, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, x binary"


def frame(spark, pairs):
    return spark.createDataFrame([(i, v, 0, -1, "c", b"") for i, v in pairs], SCHEMA).repartition(3)


def wholes(vectors):
    return np.floor(np.float32(vectors).astype(float) * 64).astype(np.int64) + 1_000_000


def collected(df):
    rows = df.collect()
    return {(r["vec_id"], r["component"]): r for r in rows}, rows


def test_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(120, 20)) * np.linspace(0.2, 3, 20) + rng.normal(size=20)).astype(np.float32)
    v[5] = v[4]
    found, rows = collected(whiten(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])))
    x = wholes(v)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    expected = (x - s / n) @ axes[:, :16] / np.sqrt(e[:16])
    assert len(rows) == 120 * 16 and n == 119
    exact = ((n * x - s) ** 2).sum(axis=1)
    for c in range(16):
        mine = np.array([found[i, c + 1]["whitened"] for i in range(120)])
        sign = np.sign(mine @ expected[:, c])
        np.testing.assert_allclose(mine * sign, expected[:, c], rtol=0, atol=1e-9)
        assert found[0, c + 1]["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-10)
    assert [int(found[i, 1]["deviation"]) for i in range(120)] == exact.tolist()
    assert {r["n"] for r in rows} == {119} and max(r["identity_error"] for r in rows) < 1e-9


def test_rows_that_take_no_part_and_low_rank(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, 2.0]), (2, [3.0, 0.0, 2.0]), (2, [3.0, 0.0, 2.0]), (None, [3.0, 0.0, 2.0]), (9, [5.0, 0.0, 4.0])]
    bad = [(3, None), (4, []), (5, [1.0, None, 2.0]), (6, [1.0, nan, 2.0]), (7, [1.0, -inf, 2.0]), (8, [1.0, 2.0]), (8, [1e30, 0.0, 0.0])]
    rows = whiten(frame(spark, good + bad)).collect()
    # Three different points: two directions have spread.
    assert sorted((r["vec_id"] or -1, r["component"]) for r in rows) == sorted(
        (i or -1, c) for i, _ in good for c in (1, 2)
    )
    assert {r["n"] for r in rows} == {3} and max(r["identity_error"] for r in rows) < 1e-12
    assert len({r["whitened"] for r in rows if r["vec_id"] in (2, None) and r["component"] == 1}) == 1


def test_nothing_to_whiten(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_large_entries_stay_exact(spark):
    rows = whiten(frame(spark, [(1, [3e10, 1.0]), (2, [-3e10, 2.0]), (3, [1e10, -5.0])])).collect()
    x = wholes([[3e10, 1.0], [-3e10, 2.0], [1e10, -5.0]]).astype(object)
    s = x.sum(axis=0)
    expected = {i + 1: sum(int(d) ** 2 for d in 3 * x[i] - s) for i in range(3)}
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == expected


def test_coinciding_eigenvalues_and_empty_directions():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(40, 8)))
    a = q * np.array([3, 3, 3, 2, 2, 1, 0, 0]) @ np.linalg.qr(rng.normal(size=(8, 8)))[0]

    def multiply(w):
        u = a @ w
        return a.T @ u, u @ u

    axes, values = bidiagonalise(multiply, 8, np.linalg.norm(a), 6, 8, 0.0)
    np.testing.assert_allclose(values, [3, 3, 3, 2, 2, 1, 0, 0], atol=1e-12)
    np.testing.assert_allclose(axes.T @ axes, np.eye(8), atol=1e-12)
    np.testing.assert_allclose(np.linalg.norm(a @ axes, axis=0), values, atol=1e-12)


def test_a_tolerance_ends_the_steps_early(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(200, 60)) * np.concatenate([[90, 50, 20], np.full(57, 0.01)])
    calls = []

    def multiply(w):
        calls.append(1)
        u = a @ w
        return a.T @ u, u @ u

    axes, values = bidiagonalise(multiply, 60, np.linalg.norm(a), 3, 60, 1e-13)
    assert len(calls) < 40
    np.testing.assert_allclose(values[:3], np.linalg.svd(a)[1][:3], rtol=1e-12)
