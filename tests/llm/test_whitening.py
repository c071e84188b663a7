import math

import numpy as np
import pytest

from termgauge.llm import whitening


def symmetric(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(values) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "spread": np.linspace(1, 50, 40),
    "close": 60 + np.linspace(0, 1e-3, 30),
    "wide": np.logspace(-14, 3, 25),
    "repeated": [5.0] * 6 + [1.0] * 6 + [0.0] * 4,
    "one": [3.0],
    "two": [3.0, -2.0],
    "shift": [0.0, 1.0, 2.0],
    "signs": np.linspace(-1, 1, 21),
    "same": [2.0] * 9,
    "zero": [0.0] * 5,
}


@pytest.mark.parametrize("name", sorted(SPECTRA))
def test_eigen(name):
    a = symmetric(np.array(SPECTRA[name]), 3)
    values, vectors = whitening.eigen(a)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.sort(SPECTRA[name])[::-1]).max() <= 1e-13 * scale + 1e-300
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * values).max() <= 2e-13 * scale


def test_diagonal_matrices():
    for d in ([3.0, 1.0, 2.0], [1.0, 1.0, 2.0, 2.0], [0.0, 0.0, 1.0]):
        values, vectors = whitening.eigen(np.diag(d))
        assert values.tolist() == pytest.approx(sorted(d, reverse=True), abs=1e-15)
        assert np.abs(np.diag(d) @ vectors - vectors * values).max() < 1e-14


def test_polar_factor_is_the_sign():
    a = symmetric(np.array([5, 1, 1e-6, -1e-9, -2.0]), 5)
    u = whitening.polar_factor(a)
    assert np.abs(u @ u - np.eye(5)).max() < 1e-13 and abs(np.trace(u) - 1) < 1e-12
    assert np.linalg.eigvalsh(u @ a).min() > -1e-14


def brute(rows, components=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = {}
    for i, v in kept:
        x[i] = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]
    fits = sorted({tuple(v) for v in x.values()})
    n, d = len(fits), len(fits[0])
    sums = [sum(v[k] for v in fits) for k in range(d)]
    y = np.array([[(n * v[k] - sums[k]) / n for k in range(d)] for v in fits])
    cov = y.T @ y / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    out = {}
    for i, v in x.items():
        t = [n * v[k] - sums[k] for k in range(d)]
        out[i] = sum(s * s for s in t), np.array(t) / n @ w[:, :components] / np.sqrt(e[:components])
    return n, e / e.sum(), out


def compare(rows, got, components):
    n, explained, want = brute(rows, components)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(want)
    signs = None
    for i, (deviation, z) in want.items():
        own = by[i]
        assert sorted(own) == list(range(1, len(z) + 1)) and {r.deviation for r in own.values()} == {deviation}
        mine = np.array([own[c].whitened for c in sorted(own)])
        signs = np.sign(mine * z) if signs is None else signs
        assert np.allclose(mine, z * signs, atol=1e-8)
        assert np.allclose([own[c].explained for c in sorted(own)], explained[: len(z)], rtol=1e-9)


def frame(spark, rows):
    table = [(i, None if v is None else [None if c is None else float(c) for c in v], 5, "x") for i, v in rows]
    return spark.createDataFrame(table, "vec_id long, embedding array<float>, x int, n string")


def test_whitening(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1 + np.arange(20) / 4, 20)) for i in range(150)]
    rows += [(200 + i, rows[i % 7][1]) for i in range(400)]  # a third of all rows in a few vectors
    bad = [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19), (904, [1.0] * 3), (905, [])]
    got = whitening.whiten_embeddings(frame(spark, rows + bad).repartition(5)).collect()
    compare(rows, got, 16)


def test_small_and_flat(spark):
    assert whitening.whiten_embeddings(frame(spark, [])).count() == 0
    assert whitening.whiten_embeddings(frame(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten_embeddings(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained) == (1, 0, None, None) for r in one)
    flat = whitening.whiten_embeddings(frame(spark, [(i, [float(i), 1.0]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-12


def test_large_numbers_are_exact_or_null(spark):
    rows = [(1, [3e30, 0.0]), (2, [-3e30, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whiten_embeddings(frame(spark, rows)).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id in (1, 2))
    x = np.array([[2**31, 0], [-(2**31), 5]], np.int64)
    own = whitening.deviations(x, np.array([0, 0]), np.array([1, 1]), 1).to_pylist()
    assert own == [(2**31 - 1) ** 2 + 1, (2**31 + 1) ** 2 + 16]
    edge = whitening.deviations(np.array([[3037000500], [3037000499]]), np.array([0]), np.array([0]), 1).to_pylist()
    assert edge == [None, 3037000499**2]


def test_sums_are_exact(spark):
    x = [[2**61 - 1, -5], [2**61 - 3, -(2**61)], [7, 2**40 + 1]]
    rows = spark.createDataFrame([(v,) for v in x], "x array<long>")
    n, sums = whitening.exact_sums(rows, 2)
    assert n == 3 and sums == [sum(v[k] for v in x) for k in range(2)]
