"""Whitening against a dense eigendecomposition, and the iteration by itself."""

import math

import numpy as np
import pytest

from statuta.llm import whitening

DDL = "vec_id long, embedding array<float>, whitened string"


def vectors(n=300, width=12, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(0, np.linspace(0.6, 0.1, width), (n, width))
    return [(i, [float(np.float32(c)) for c in v], "x") for i, v in enumerate(x)]


def odd(rows, width=12):
    return rows + [
        (7, rows[7][1], "x"),
        (None, rows[3][1], None),
        (900, None, "x"),
        (901, [], "x"),
        (902, [float("nan")] * width, "x"),
        (903, [None] * width, "x"),
        (904, [float("inf"), *[0.0] * (width - 1)], "x"),
        (905, [1.0, 2.0], "x"),
        (906, [-0.0] * width, "x"),
    ]


def dense(rows, width):
    ok = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in ok}), float)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    return ok, fit, e[::-1], u[:, ::-1]


def test_rows_are_those_of_a_dense_decomposition(spark):
    rows = odd(vectors())
    ok, fit, e, u = dense(rows, 12)
    found = whitening.whiten(spark.createDataFrame(rows, DDL)).collect()
    assert len(found) == 4 * len(ok)
    n, sums = len(fit), fit.sum(axis=0).astype(int).tolist()
    signs = {}
    want = {}
    for i, x in ok:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(4):
            want.setdefault((i, c + 1), []).append((dev, (np.array(x) - fit.mean(axis=0)) @ u[:, c] / math.sqrt(e[c])))
    for r in found:
        devs = [d for d, _ in want[r["vec_id"], r["component"]]]
        w = dict(want[r["vec_id"], r["component"]])[r["deviation"]]
        assert r["deviation"] in devs and r["n"] == n
        signs.setdefault(r["component"], []).append(np.sign(w * r["whitened"]) if abs(w) > 1e-6 else 0)
        assert abs(abs(r["whitened"]) - abs(w)) < 1e-9
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-9 and r["identity_error"] < 1e-9
    assert all(len(set(s) - {0}) == 1 for s in signs.values())
    assert sum(r["vec_id"] is None for r in found) == 4 and sum(r["vec_id"] == 7 for r in found) == 8


def test_copies_weigh_once(spark):
    rows = vectors(60, 6)
    many = rows + [(1000 + i, rows[0][1], "x") for i in range(500)]
    one, other = (whitening.whiten(spark.createDataFrame(r, DDL)).where("component = 1 AND vec_id = 5").first() for r in (rows, many))
    assert one["n"] == other["n"] == 60 and abs(abs(one["whitened"]) - abs(other["whitened"])) < 1e-9


def test_few_vectors_and_few_dimensions(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, DDL)).collect()
    assert make([]) == [] and make([(1, [1.0, 2.0], "x")] * 3) == [] and make([(1, None, "x")]) == []
    line = make([(i, [float(i), 2.0 * i, 0.0], "x") for i in range(5)])
    assert len(line) == 5 and {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12
    assert len(make([(i, [float(i * i)], "x") for i in range(5)])) == 5
    huge = make([(i, [1e30 * i, float(i % 2)], "x") for i in range(3)])
    assert {r["deviation"] for r in huge} == {None}


@pytest.mark.parametrize("size, space", [(5, 24), (64, 24), (200, 40)])
def test_iteration_on_graded_close_and_equal_eigenvalues(size, space):
    r = np.random.default_rng(size)
    q, _ = np.linalg.qr(r.normal(size=(size, size)))
    for e in (np.linspace(2, 1, size), 10.0 ** -np.linspace(0, 8, size), np.r_[3.0, 3.0, 3.0, np.ones(size - 3)], -np.arange(size) + 2.0):
        a = (q * e) @ q.T
        a = (a + a.T) / 2
        values, vectors_ = whitening.jacobi_davidson(lambda b: a @ b, size, 4, space)
        assert np.allclose(values, np.sort(e)[::-1][:4], rtol=0, atol=1e-12 * np.abs(e).max())
        residual = np.linalg.norm(a @ vectors_ - vectors_ * values, axis=0)
        assert residual.max() < 1e-12 * np.abs(e).max() and np.allclose(vectors_.T @ vectors_, np.eye(4), atol=1e-12)


def test_minres_solves_indefinite_systems():
    r = np.random.default_rng(3)
    a = r.normal(size=(30, 30))
    a = a + a.T
    b = r.normal(size=(30, 3))
    assert np.allclose(a @ whitening.minres(lambda x: a @ x, b, 200, 1e-12), b, atol=1e-6)
    assert (whitening.minres(lambda x: a @ x, 0 * b, 5, 0.1) == 0).all()
