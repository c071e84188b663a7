import numpy as np
import pytest
from pyspark.sql import functions as F

from termgauge.operators import models

CELL = ("cell",)


def newton(t, n, k, penalty):
    """Penalised logistic fit on dense arrays."""
    x = np.column_stack([t, np.ones_like(t)])
    theta = np.array([0.0, np.log((k.sum() + 0.5) / (n.sum() - k.sum() + 0.5))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ theta))
        gradient = x.T @ (n * p - k) + penalty * theta
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        theta = theta - np.linalg.solve(hessian, gradient)
    return theta


@pytest.fixture(scope="module")
def keys(spark):
    rng = np.random.default_rng(3)
    rows = []
    for cell, coef, intercept in (("rising", 1.1, -4.0), ("falling", -0.7, 3.0), ("steep", 4.0, -20.0)):
        f = rng.integers(1, 10**6, 150)
        n = rng.integers(1, 40, 150)
        k = rng.binomial(n, 1 / (1 + np.exp(-(coef * np.log10(f) + intercept))))
        rows += [(cell, float(a), int(b), int(c)) for a, b, c in zip(f, n, k)]
    rows += [("all right", 10.0, 5, 5), ("all right", 20.0, 5, 5)]
    return spark.createDataFrame(rows, "cell string, frequency double, answers long, correct long").cache()


def arrays(keys, cell, log):
    pdf = keys.where(F.col("cell") == cell).toPandas()
    return log(pdf.frequency.to_numpy()), pdf.answers.to_numpy(), pdf.correct.to_numpy()


def test_logistic_fit(keys):
    fit = {r.cell: r for r in models.logistic_fit(keys, CELL).collect()}
    for cell in ("rising", "falling", "steep"):
        t, n, k = arrays(keys, cell, np.log10)
        want = newton(t, n, k, np.array([1.0, 0.0]))
        assert (fit[cell].coef, fit[cell].intercept) == pytest.approx(tuple(want), rel=1e-7)
        assert (fit[cell].t_min, fit[cell].t_max, fit[cell].answers) == pytest.approx((t.min(), t.max(), n.sum()))
    assert fit["all right"].coef is None


def test_logistic_fit_equals_spark_ml(spark, keys):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = keys.where("cell = 'rising'").selectExpr(
        "log10(frequency) AS t",
        "inline(array(struct(1.0D AS label, double(correct) AS w), struct(0.0D AS label, double(answers - correct) AS w)))",
    )
    n = rows.agg(F.sum("w")).first()[0]
    data = VectorAssembler(inputCols=["t"], outputCol="features").transform(rows)
    ml = LogisticRegression(
        weightCol="w", regParam=1 / n, elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=500
    ).fit(data)
    fit = models.logistic_fit(keys.where("cell = 'rising'"), CELL).first()
    assert (fit.coef, fit.intercept) == pytest.approx((ml.coefficients[0], ml.intercept), rel=1e-5)


def test_logistic_curve(keys):
    fit = models.logistic_fit(keys.where("cell = 'rising'"), CELL)
    row = fit.first()
    curve = models.logistic_curve(fit, CELL).orderBy("point").toPandas()
    t = np.linspace(row.t_min, row.t_max, 10_000)
    assert len(curve) == 10_000
    assert np.allclose(curve.frequency, 10**t)
    assert np.allclose(curve.probability, 1 / (1 + np.exp(-row.coef * t - row.intercept)))


def test_bayes(spark, keys):
    wanted = keys.where("cell IN ('rising', 'falling')").repartition(3)
    samples = models.bayes_logistic(wanted, CELL, draws=24_000, burn=4_000, thin=2).cache()
    for cell in ("rising", "falling"):
        t, n, k = arrays(keys, cell, np.log)
        mode = newton(t, n, k, np.array([0.001, 0.001]))
        pdf = samples.where(F.col("cell") == cell).toPandas()
        assert len(pdf) == 10_000
        x = np.column_stack([t, np.ones_like(t)])
        p = 1 / (1 + np.exp(-x @ mode))
        spread = np.sqrt(np.diag(np.linalg.inv((x * (n * p * (1 - p))[:, None]).T @ x)))
        assert -pdf.beta.mean() == pytest.approx(mode[0], abs=0.1 * spread[0])
        assert -pdf.alpha.mean() == pytest.approx(mode[1], abs=0.1 * spread[1])
        assert pdf.beta.std() == pytest.approx(spread[0], rel=0.1)
        assert pdf.beta.nunique() > 5_000
    again = models.bayes_logistic(wanted.repartition(1), CELL, draws=24_000, burn=4_000, thin=2)
    a, b = (df.groupBy("cell").agg(F.avg("beta")).orderBy("cell").collect() for df in (samples, again))
    assert [r[1] for r in a] == pytest.approx([r[1] for r in b], rel=1e-9)

    band = models.posterior_band(samples, CELL).where("cell = 'rising'").orderBy("point").toPandas()
    pdf = samples.where("cell = 'rising'").toPandas()
    t = np.linspace(pdf.t_min[0] - 5, pdf.t_max[0] + 5, 100)
    p = 1 / (1 + np.exp(np.outer(pdf.beta, t) + pdf.alpha.to_numpy()[:, None]))
    assert np.allclose(band["mean"], p.mean(axis=0))
    assert np.allclose(band.frequency, np.exp(t))
    for name, share in (("low", 0.025), ("high", 0.975)):
        ordered, n = np.sort(p, axis=0), len(p)
        place = n * share + 0.4 + 0.2 * share
        at = int(place)
        assert np.allclose(band[name], ordered[at - 1] + (place - at) * (ordered[at] - ordered[at - 1]))


def posterior(keys, cell, size=301):
    """Mass of the posterior on a dense even grid around its mean, by doubling back on its own moments."""
    t, n, k = arrays(keys, cell, np.log)
    theta = newton(t, n, k, np.array([0.001, 0.001]))
    x = np.column_stack([t, np.ones_like(t)])
    p = 1 / (1 + np.exp(-x @ theta))
    root = np.linalg.cholesky(np.linalg.inv((x * (n * p * (1 - p))[:, None]).T @ x + 0.001 * np.eye(2)))
    for reach in (30, 9, 9):
        z = np.linspace(-reach, reach, size)
        z0, z1 = (g.ravel() for g in np.meshgrid(z, z))
        ab = theta + np.column_stack([z0, z1]) @ root.T
        lp = -0.0005 * (ab**2).sum(axis=1)
        for tt, nn, kk in zip(t, n, k):
            eta = ab @ [tt, 1]
            lp += kk * eta - nn * np.logaddexp(0, eta)
        w = np.exp(lp - lp.max())
        w /= w.sum()
        theta = w @ ab
        cov = ((ab - theta) * w[:, None]).T @ (ab - theta)
        root = np.linalg.cholesky(cov)
    return ab, w, theta, cov, t


@pytest.mark.parametrize("cell", ["rising", "steep", "all right"])
def test_quadrature(keys, cell):
    nodes = models.posterior_nodes(keys.where(F.col("cell") == cell), CELL).cache()
    ab, w, mean, cov, t = posterior(keys, cell)
    got = models.posterior_moments(nodes, CELL).first()
    sd = np.sqrt(np.diag(cov))
    skewed = cell == "all right"  # two levels, both all right: half of the prior's plane
    assert np.abs(np.array([got.m0, got.m1]) - mean).max() < (0.03 if skewed else 1e-4) * sd.max()
    assert (got.v00, got.v11) == pytest.approx(tuple(sd**2), rel=0.05 if skewed else 1e-3)
    assert nodes.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    band = models.quadrature_band(nodes, CELL, 25).orderBy("point").toPandas()
    at = np.linspace(t.min() - 5, t.max() + 5, 25)
    assert np.allclose(band.frequency, np.exp(at))
    for k, tt in enumerate(at):
        p = 1 / (1 + np.exp(-np.clip(ab @ [tt, 1], -700, 700)))
        order = np.argsort(p)
        low, high = np.interp((0.025, 0.975), np.cumsum(w[order]), p[order])
        assert abs(band["mean"][k] - w @ p) < (0.03 if skewed else 0.001)
        # Where all answers are right the ends of the band are cliffs, which the nodes place to a few percent of mass.
        assert skewed or (abs(band.low[k] - low) < 0.01 and abs(band.high[k] - high) < 0.01)


def test_chains_mix(keys):
    samples = models.bayes_logistic(keys, CELL, draws=24_000, burn=4_000, thin=2).cache()
    got = {r.cell: r for r in models.chain_diagnostics(samples, CELL).collect()}
    assert set(got) == {"rising", "falling", "steep", "all right"}
    for cell, r in got.items():
        pdf = samples.where(F.col("cell") == cell).toPandas()
        assert r.samples == len(pdf) == 10_000 and sorted(pdf.chain.unique()) == [0, 1, 2, 3]
        halves = [g.beta.to_numpy() for _, g in pdf.groupby(["chain", "half"])]
        assert {len(h) for h in halves} == {1250}
        within, between = np.mean([h.var() for h in halves]), np.var([h.mean() for h in halves], ddof=1)
        assert r.beta_rhat == pytest.approx(np.sqrt((within + between) / within), rel=1e-6)
        assert r.beta_mean == pytest.approx(pdf.beta.mean()) and r.beta_sd == pytest.approx(pdf.beta.std(ddof=0))
        assert max(r.beta_rhat, r.alpha_rhat) < 1.01 and 1000 < r.beta_ess < 20_000
    stuck = samples.where("cell = 'rising'").withColumn("beta", F.col("beta") + 5 * F.col("chain"))
    apart = models.chain_diagnostics(stuck, CELL).first()
    assert apart.beta_rhat > 2 and apart.alpha_rhat < 1.01


def test_band_where_the_chain_is_walked(keys):
    wanted = keys.where("cell IN ('rising', 'falling')")
    how = {"by": CELL, "draws": 3_000, "burn": 1_000, "thin": 2}
    want = models.posterior_band(models.bayes_logistic(wanted, **how), CELL).orderBy("cell", "point").toPandas()
    got = models.bayes_band(wanted, **how).orderBy("cell", "point").toPandas()
    assert len(got) == 200 and list(got.cell) == list(want.cell)
    for name in ("frequency", "mean", "low", "high"):
        assert np.allclose(got[name], want[name])


def test_likelihoods_of_parts_are_summed(keys, monkeypatch):
    wanted = keys.where("cell = 'rising'")
    how = {"by": CELL, "draws": 2_000, "burn": 500, "thin": 2}
    whole = models.bayes_logistic(wanted, **how).orderBy("draw").toPandas()
    monkeypatch.setattr(models, "LEVELS_PER_TASK", 40)
    parts = models.bayes_logistic(wanted, **how).orderBy("draw").toPandas()
    assert np.allclose(whole.beta.mean(), parts.beta.mean(), rtol=1e-6)


def test_fits_tell_whether_they_converged(keys):
    fit = {r.cell: r.converged for r in models.logistic_fit(keys, CELL).collect()}
    assert fit["rising"] and fit["steep"] and fit["all right"] is None
    counts = models.sufficient_counts(keys, F.log10("frequency"), CELL)
    short = {r.cell: r.converged for r in models.newton_fit(counts, CELL, max_iter=1).collect()}
    assert short["steep"] is False
