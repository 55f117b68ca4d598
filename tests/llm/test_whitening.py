import math
import random

import numpy as np

from codeatlas.llm import whitening
from codeatlas.llm.bidiagonal import bidiagonalise, dqds, leading_directions
from codeatlas.llm.whitening import apply_whitening, fit_whitening, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, x string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], SCHEMA)


def whole(v):
    return None if not v or any(c is None or not math.isfinite(c) for c in v) else tuple(math.floor(256 * float(np.float32(c))) for c in v)


def plain(rows, want=4):
    """{(id, component): (n, deviation, whitened, explained)} by numpy's own solver; whitened up to its sign."""
    kept = [(i, x) for i, v in rows if (x := whole(v))]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, x in kept:
        exact = [n * a - s for a, s in zip(x, sums)]
        for c in range(want):
            e = values[-1 - c]
            out.append((i, c + 1, n, sum(a * a for a in exact), abs(np.array(exact, float) / n @ vectors[:, -1 - c]) / e**0.5, e / values.sum()))
    return out


def sample(rng, n, d):
    return [(i, [rng.gauss(0, 1 / (1 + k)) for k in range(d)]) for i in range(n)]


def compare(found, wanted):
    key = lambda r: (str(r[0]), r[1], r[3], round(abs(r[4]), 6))
    found, wanted = sorted(found, key=key), sorted(wanted, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    assert np.allclose([abs(r[4]) for r in found], [r[4] for r in wanted], atol=1e-9) and np.allclose([r[5] for r in found], [r[5] for r in wanted], rtol=1e-9)


def test_whitened_rows_agree_with_plain(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_BYTES", 8 * 12 * 12 * 2)
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 3000)
    rng = random.Random(3)
    rows = sample(rng, 400, 12)
    rows += [(1000 + i, rows[5][1]) for i in range(300)] + [(None, rows[7][1]), (8, rows[8][1]), (9, rows[10][1])]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 11 + [None]), (2003, [1.0] * 11 + [math.nan]), (2004, [math.inf] + [0.0] * 11), (2005, [None] * 12), (2006, [-math.inf] * 12)]
    vectors = whole_vectors(frame(spark, rows + bad).repartition(9))
    result = apply_whitening(vectors, fit_whitening(vectors, 4)).collect()
    compare([tuple(r)[:6] for r in result], plain(rows))
    assert len({r.identity_error for r in result}) == 1 and result[0].identity_error < 1e-9
    one = {(r.component, r.whitened) for r in result if r.vec_id is not None and 1000 <= r.vec_id < 1300}
    assert len(one) == 4  # the same sign and value for equal rows


def test_odd_tables(spark):
    empty = whole_vectors(frame(spark, []))
    assert fit_whitening(empty, 4) is None and apply_whitening(empty, None).collect() == []
    alike = whole_vectors(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]))
    assert fit_whitening(alike, 4) is None
    flat = whole_vectors(frame(spark, [(i, [i / 8, i / 4, 0.0]) for i in range(20)] + [(50, [1.0, 2.0])] * 3))  # rank 1, and vectors of another length
    fit = fit_whitening(flat, 4)
    assert len(fit.values) == 1 and fit.n == 20 and fit.identity_error < 1e-9
    assert apply_whitening(flat, fit).count() == 20
    huge = whole_vectors(frame(spark, [(i, [float(i) * 1e12, float(i * i % 7) * 1e12]) for i in range(60)]))
    fit = fit_whitening(huge, 2)
    rows = apply_whitening(huge, fit).collect()
    assert len(rows) == 120 and all(r.deviation is None for r in rows if r.vec_id > 40) and fit.identity_error < 1e-9


def test_values_below_zero_are_floored(spark):
    assert [r.x for r in whole_vectors(frame(spark, [(1, [-0.001, 0.0, -0.0, 0.0039])])).collect()] == [[-1, 0, 0, 0]]


def check(a, want):
    r = np.linalg.qr(a, mode="r") if len(a) else a
    values, vectors = leading_directions(r, want)
    gram = a.T @ a
    top = np.linalg.eigvalsh(gram)[::-1][: len(values)]
    size = max(top.max(initial=0), 1e-300)
    assert np.abs(values - top).max(initial=0) < 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-9
    assert np.abs(gram @ vectors - vectors * values).max(initial=0) < 1e-12 * size
    return len(values)


def test_directions_of_hard_triangles():
    rng = np.random.RandomState(0)
    turn = np.linalg.qr(rng.randn(32, 32))[0]
    assert check(rng.randn(200, 32), 32) == 32
    assert check(rng.randn(200, 32) * np.logspace(0, -6, 32), 32) == 32
    assert check(np.vstack([np.eye(9)] * 3), 9) == 9
    assert check(turn, 32) == 32  # all values equal
    assert check(np.diag(np.r_[1 + 1e-9, 1 + 5e-10, np.ones(10), np.full(20, 1e-3)]) @ turn, 32) == 32
    wilkinson = np.diag(np.abs(np.arange(-10, 11)) + 11.0) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    assert check(np.linalg.cholesky(wilkinson).T, 21) == 21
    assert check(rng.randn(5, 20), 8) == 5
    assert check(np.ones((30, 6)), 4) == 1
    assert check(np.zeros((30, 6)), 4) == 0
    assert check(np.zeros((0, 5)), 4) == 0
    assert check(rng.randn(3, 1), 4) == 1


def test_small_values_keep_their_accuracy():
    a, b = np.array([1.0, 1e-5, 1e-9, 2.0]), np.array([1e-3, 1e-6, 1e-9])
    found = np.sqrt(dqds(a, b))
    from decimal import Decimal, getcontext

    getcontext().prec = 80
    product = math.prod(map(Decimal, map(float, a)))  # the determinant is known to all digits
    assert abs(float(math.prod(map(Decimal, map(float, found))) / product) - 1) < 1e-13
    d, e, _ = bidiagonalise(np.diag(a) + np.diag(b, 1))
    assert np.allclose(np.sqrt(dqds(d, e))[:2], found[:2], rtol=1e-14)
