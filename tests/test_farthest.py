import numpy as np
import pytest
from pyspark.sql import functions as F

from termgauge.operators import farthest

CELL = ("cell",)


def brute(points, n):
    """All pairs of (key, parts, f, a), best first."""
    out = []
    for i in points:
        for j in points:
            before = i[1][0] < j[1][0] if len(i[1]) == 1 else i[0] < j[0]
            if not before:
                continue
            gap = np.prod([0.01 if x == y else abs(x - y) for x, y in zip(i[1], j[1])])
            out.append(((i[2] - j[2]) ** 3 * (i[3] - j[3]) / gap**2, i[0], j[0]))
    return sorted(out, key=lambda r: (-r[0], r[1], r[2]))[:n]


def is_round(parts):
    return any(p < 10 or p % 10 == 0 for p in parts)


def random_points(size, count, seed, flat=False):
    rng = np.random.default_rng(seed)
    seen = {}
    while len(seen) < count:
        parts = sorted((int(v) for v in rng.integers(1, 900 if size == 1 else 60, size)), key=str)
        key = str(parts[0]) if size == 1 else "(" + ", ".join(f"'{p}'" for p in parts) + ")"
        f = 5.0 if flat else float(rng.integers(1, 1000) ** 2)
        seen[key] = (key, parts, f, float(rng.integers(0, 9)) / 8)
    return list(seen.values())


@pytest.mark.parametrize("size,count,n", [(1, 400, 100), (2, 500, 100), (3, 300, 25), (2, 6, 100)])
def test_best_pairs_match_brute_force(spark, size, count, n):
    cells = {"a": random_points(size, count, 1), "b": random_points(size, count // 2, 2)}
    rows = [(c, *p) for c, points in cells.items() for p in points]
    keys = spark.createDataFrame(rows, "cell string, key string, parts array<long>, frequency double, accuracy double")
    got = farthest.farthest_points(keys, size, n, CELL).orderBy("cell", "rank").collect()
    for cell, points in cells.items():
        want = brute([p for p in points if not is_round(p[1])], n)
        mine = [r for r in got if r.cell == cell]
        assert [r.rank for r in mine] == list(range(1, len(want) + 1))
        assert np.allclose([r.score for r in mine], [w[0] for w in want], rtol=1e-9)
        assert {(r.key_i, r.key_j) for r in mine[:10]} == {w[1:] for w in want[:10]}


def test_equal_frequencies_and_own_filter(spark):
    points = random_points(2, 60, 4, flat=True)
    keys = spark.createDataFrame(
        [("a", *p) for p in points], "cell string, key string, parts array<long>, frequency double, accuracy double"
    )
    got = farthest.farthest_points(keys, 2, 50, CELL, index_filter=lambda parts: F.size(parts) > 0)
    want = brute(points, 50)
    assert [(r.key_i, r.key_j) for r in got.orderBy("rank").collect()] == [w[1:] for w in want]


def frame_of(spark, points):
    return spark.createDataFrame(
        [("a", *p) for p in points], "cell string, key string, parts array<long>, frequency double, accuracy double"
    )


def opened(spark, points, size, n, **how):
    """The best pairs, and how many pairs of keys were opened for them."""
    seen = []
    got = farthest.farthest_points(
        frame_of(spark, points), size, n, CELL, lambda parts: F.size(parts) > 0, watch=lambda r: seen.append(r.agg(F.sum("pairs")).first()[0] or 0), **how
    )
    return [(r.score, r.key_i, r.key_j) for r in got.orderBy("rank").collect()], sum(seen)


def same(got, want):
    return np.allclose([g[0] for g in got], [w[0] for w in want], rtol=1e-9) and [g[1:] for g in got] == [w[1:] for w in want]


@pytest.fixture
def not_eager(monkeypatch):
    monkeypatch.setattr(farthest, "EAGER", 30_000)


def test_few_pairs_are_opened(spark, not_eager):
    """A smaller share of all pairs, the more keys there are."""
    shares = []
    for count in (400, 1600):
        points = random_points(2, count, 5)
        got, pairs = opened(spark, points, 2, 100)
        assert same(got[:10], brute(points, 10))
        shares.append(pairs / (count * (count - 1) / 2))
    assert shares[0] < 0.6 and shares[1] < 0.2


@pytest.mark.parametrize("size", [1, 2])
@pytest.mark.parametrize("kind", ["flat accuracy", "falling accuracy", "all flat"])
def test_cells_without_a_positive_score(spark, not_eager, size, kind):
    points = random_points(size, 700, 6)
    slope = {"flat accuracy": 0.0, "falling accuracy": -1e-6, "all flat": 0.0}[kind]
    points = [(k, p, 5.0 if kind == "all flat" else f, 0.5 + slope * f) for k, p, f, _ in points]
    got, pairs = opened(spark, points, size, 60)
    want = brute(points, 60)
    assert same(got, want)
    assert pairs < 0.3 * len(points) ** 2 / 2


def test_a_hundred_thousand_keys_of_equal_accuracy(spark, not_eager):
    rows = spark.range(100_000).selectExpr(
        "'a' AS cell", "format_string('%06d', id) AS key", "array(id + 100, id * 7919 % 100003) AS parts",
        "CAST(id * 31 % 9973 + 1 AS DOUBLE) AS frequency", "0.25D AS accuracy",
    )
    seen = []
    got = farthest.farthest_points(rows, 2, 100, CELL, lambda parts: F.size(parts) > 0, watch=lambda r: seen.append(r.agg(F.sum("pairs")).first()[0] or 0))
    found = [(r.key_i, r.key_j, r.score) for r in got.orderBy("rank").collect()]
    assert found == [("000000", f"{k:06d}", 0.0) for k in range(1, 101)]
    assert sum(seen) < 0.001 * 100_000**2 / 2


def difference_bound(i, j, size):
    """Of |f_i - f_j| |a_i - a_j| / gaps^2."""
    widest = lambda low, high: F.greatest(high(i) - low(j), high(j) - low(i))
    near = F.lit(1.0)
    for c in range(size):
        apart = F.greatest(F.get(i.low, F.lit(c)) - F.get(j.high, F.lit(c)), F.get(j.low, F.lit(c)) - F.get(i.high, F.lit(c)))
        near = near * F.when(apart > 0, apart).otherwise(F.lit(0.01))
    near = F.greatest(near, F.lit(0.01 ** (size - 1)))
    most = widest(lambda x: x.f_low, lambda x: x.f_high) * widest(lambda x: x.a_low, lambda x: x.a_high)
    return most / F.pow(near, 2) * (1 + 1e-9)


def test_own_scorers_with_a_bound(spark, not_eager):
    rng = np.random.default_rng(9)
    x = np.unique(rng.integers(1, 800, (6000, 2)), axis=0)
    f, a = rng.integers(1, 1000, len(x)) ** 2.0, rng.random(len(x))
    points = [(f"{p[0]:03d}-{p[1]:03d}", p.tolist(), float(g), float(h)) for p, g, h in zip(x, f, a)]
    own = dict(freq_score=lambda i, j: F.abs(i - j), acc_score=lambda i, j: F.abs(i - j))
    got, pairs = opened(spark, points, 2, 20, bound=difference_bound, **own)
    i, j = np.triu_indices(len(x), 1)
    gaps = np.where(x[i] == x[j], 0.01, np.abs(x[i] - x[j])).prod(axis=1)
    score = np.abs(f[i] - f[j]) * np.abs(a[i] - a[j]) / gaps**2
    top = np.argsort(-score)[:20]
    want = [(score[k], points[i[k]][0], points[j[k]][0]) for k in top]
    assert same(got, want) and pairs < 0.05 * len(x) ** 2 / 2


def test_scorers_without_a_bound_refuse_large_cells(spark, monkeypatch):
    monkeypatch.setattr(farthest, "UNBOUNDED", 40)
    frame = frame_of(spark, random_points(2, 60, 7))
    with pytest.raises(ValueError, match="scorers without a bound"):
        farthest.farthest_points(frame, 2, 5, CELL, lambda parts: F.size(parts) > 0, acc_score=lambda i, j: F.lit(1.0))


def test_own_scorers(spark):
    points = random_points(2, 50, 7)
    frame = spark.createDataFrame(
        [("a", *p) for p in points], "cell string, key string, parts array<long>, frequency double, accuracy double"
    )
    got = farthest.farthest_points(
        frame, 2, 5, CELL, lambda parts: F.size(parts) > 0, freq_score=lambda i, j: -F.abs(i - j), acc_score=lambda i, j: F.lit(1.0)
    )
    want = []
    for i in points:
        for j in points:
            if i[0] < j[0]:
                gap = np.prod([0.01 if x == y else abs(x - y) for x, y in zip(i[1], j[1])])
                want.append((-abs(i[2] - j[2]) / gap**2, i[0], j[0]))
    want = sorted(want, key=lambda r: (-r[0], r[1], r[2]))[:5]
    assert [(r.key_i, r.key_j) for r in got.orderBy("rank").collect()] == [w[1:] for w in want]
