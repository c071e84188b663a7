import math

import numpy as np
import pandas as pd
import pytest

from termgauge.functions import stats
from termgauge.operators import accuracy as acc

CELL = ("cell",)


def keys_frame(spark, cells):
    """cells: {name: (frequencies, accuracies)}"""
    rows = [(c, float(f), float(a)) for c, (fs, as_) in cells.items() for f, a in zip(fs, as_)]
    return spark.createDataFrame(rows, "cell string, frequency double, accuracy double")


def expected_bins(f, a, q):
    """Quantile bins as numpy computes them."""
    f, a = np.array(f, float), np.array(a, float)
    edges = np.quantile(f, np.linspace(0, 1, q + 1))
    edges[-1] += 1
    bins = np.digitize(f, edges)
    out = []
    for b in range(1, q + 1):
        part = a[bins == b]
        if len(part) == 0:
            out.append((0, 0.0, 0.0) if b < bins.min() else (0, None, None))
        else:
            h = part.std(ddof=1) / math.sqrt(len(part)) * t_quantile(len(part) - 1) if len(part) > 1 else None
            out.append((len(part), part.mean(), h))
    return edges, out


def t_quantile(v):
    """97.5% quantile of Student's t by integrating its density."""
    scale = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)

    def upper_half(x, n=4000):
        u = np.linspace(0, math.atan(x), n + 1)
        y = (1 + np.tan(u) ** 2 / v) ** (-(v + 1) / 2) / np.cos(u) ** 2
        return scale * (u[1] - u[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())

    low, high = 1.5, 14.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if upper_half(mid) < 0.475 else (low, mid)
    return low


def random_cells():
    rng = np.random.default_rng(7)
    cells = {f"r{i}": (rng.integers(1, 10**6, n), rng.integers(0, 9, n) / 8) for i, n in enumerate((11, 40, 333))}
    cells["ties"] = ([1] * 30 + [2] * 3 + [5, 9, 9, 1000], rng.random(37))
    cells["top_ties"] = (list(range(1, 6)) + [50] * 40, rng.random(45))
    cells["exact"] = (range(1, 12), rng.random(11))
    cells["one"] = ([4], [1.0])
    cells["same"] = ([7] * 12, rng.random(12))
    return {c: (list(f), list(a)) for c, (f, a) in cells.items()}


def test_t_quantiles(spark):
    found = spark.range(0, 200).selectExpr("id", f"{stats.t_975_sql('id')} AS t").collect()
    assert found[0].t is None
    for row in found[1:60] + found[120:124]:
        assert row.t == pytest.approx(t_quantile(row.id), abs=2e-7)


@pytest.mark.parametrize("q", [2, 5, 10])
def test_bins_match_numpy(spark, q):
    cells = random_cells()
    keys = keys_frame(spark, cells)
    edges = {r.cell: r.edges for r in acc.frequency_quantiles(keys, q, CELL).collect()}
    bins = acc.bin_table(keys, q, CELL).toPandas().sort_values("bin")
    for cell, (f, a) in cells.items():
        want_edges, want = expected_bins(f, a, q)
        assert edges[cell] == list(want_edges)
        got = bins[bins.cell == cell]
        assert list(got["keys"]) == [n for n, _, _ in want]
        assert got["keys"].sum() == len(f)
        for g, (_, mean, h) in zip(got.itertuples(), want):
            assert (pd.isna(g.accuracy) and mean is None) or g.accuracy == pytest.approx(mean)
            assert (pd.isna(g.h) and h is None) or g.h == pytest.approx(h, abs=1e-7)
        low, high = want_edges[:-1], want_edges[1:]
        assert np.allclose(got.mid, np.sqrt(low * high)) and np.allclose(got.width, high - low)
        t = np.linspace(0, 1, q)
        assert np.allclose(got.dilated, np.exp((1 - t) * np.log(low) + t * np.log(high)))


def test_curve_and_gap(spark):
    cells = {"a": random_cells()["r2"]}
    bins = acc.bin_table(keys_frame(spark, cells), 10, CELL)
    edges, want = expected_bins(*cells["a"], 10)
    means = np.array([m for _, m, _ in want])
    mid = np.sqrt(edges[:-1] * edges[1:])

    def beyond(i, j, edge):
        slope = (means[j] - means[i]) / (np.log(mid[j]) - np.log(mid[i]))
        return means[i] + slope * (np.log(edge) - np.log(mid[i]))

    curve = acc.extrapolated_curve(bins, CELL).orderBy("point").toPandas()
    assert list(curve.point) == list(range(12))
    assert np.allclose(curve.frequency, [edges[0], *mid, edges[-1]])
    assert np.allclose(curve.accuracy, [beyond(0, 1, edges[0]), *means, beyond(-2, -1, edges[-1])])
    gap = acc.performance_gap(bins, CELL).first()
    assert gap.gap == pytest.approx(means[-1] - means[0])


def test_correlations_match_pandas(spark):
    cells = random_cells()
    keys = keys_frame(spark, cells)
    spearman = {r.cell: r.spearman for r in acc.spearman_corr(keys, CELL).collect()}
    pearson = {r.cell: r.pearson for r in acc.pearson_log_corr(keys, CELL).collect()}
    assert {c for c, v in spearman.items() if v is None} == {"one", "same"}
    assert {c for c, v in pearson.items() if v is None} == {"one", "same"}
    for cell in set(cells) - {"one", "same"}:
        f, a = (pd.Series(v, dtype=float) for v in cells[cell])
        assert spearman[cell] == pytest.approx(f.rank().corr(a.rank()))
        assert pearson[cell] == pytest.approx(np.log(f).corr(a))


def test_ranks_of_any_number(spark):
    values = [-5e9, -2.0, -1.0, -1e-9, 0.0, 1e-300, 0.3, 0.3, 1.0, 1.5, 7.0, 1e12]
    df = keys_frame(spark, {"a": (values, values)}).groupBy("cell", "frequency").count()
    ranks = acc.cumulative(df, CELL, "frequency", "count").orderBy("frequency").collect()
    assert [r.below for r in ranks] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    assert {r.total for r in ranks} == {12}


def test_no_task_sorts_a_whole_cell(spark):
    """Running sums over values are cut into value buckets."""
    keys = keys_frame(spark, {"a": ([1, 2], [0, 1])})
    plan = acc.spearman_corr(keys, CELL)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "frequency" in line.split("windowspec")[1]]
    assert windows and all("bucket" in line for line in windows)
