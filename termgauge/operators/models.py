"""Logistic models of accuracy against frequency.

Answers of one frequency are exchangeable, so a table of distinct frequencies with the number
of answers and of right ones carries the whole likelihood. Fits are Newton steps whose sums
Spark computes for all cells at once; the sampler evaluates the likelihood of all its proposals
in one pass over that table and only then walks the chain, which reads one number per draw.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping, Sequence
from types import MappingProxyType

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgauge.operators.accuracy import CELL
from termgauge.session import discard, materialise, written


def sufficient_counts(keys: DataFrame, t: Column, by: Sequence[str] = CELL) -> DataFrame:
    """``by, t, answers, correct``: answers summed per distinct value of ``t``."""
    return (
        keys.withColumn("t", t)
        .groupBy(*by, "t")
        .agg(F.sum("answers").alias("answers"), F.sum("correct").alias("correct"))
    )


def newton_fit(
    counts: DataFrame,
    by: Sequence[str] = CELL,
    penalty: tuple[float, float] = (1.0, 0.0),
    max_iter: int = 50,
    tolerance: float = 1e-9,
) -> DataFrame:
    """Penalised maximum likelihood of ``P(correct) = 1 / (1 + exp(-(coef t + intercept)))``.

    ``penalty`` weighs the squares of coef and intercept (halved) in the negative log
    likelihood. Returns per cell ``coef, intercept``, the Hessian ``h00, h01, h11`` at the
    optimum, ``answers``, ``t_min, t_max`` and ``converged``: whether the last step moved the log
    odds by less than ``tolerance``. Cells whose answers are all right or all wrong have
    no finite optimum without a penalty on the intercept; coef and intercept are NULL there.
    """
    by = list(by)
    l0, l1 = (f"{float(p)!r}D" for p in penalty)
    counts = materialise(counts, "sufficient-counts")
    cells = counts.groupBy(*by).agg(
        F.sum("answers").alias("answers"),
        F.sum("correct").alias("correct"),
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
    )
    cells = materialise(cells, "cells")
    # Start at the overall log odds.
    state = cells.where(f"{l1} > 0 OR (correct > 0 AND correct < answers)").selectExpr(
        *by,
        "0.0D AS coef",
        "ln((correct + 0.5D) / (answers - correct + 0.5D)) AS intercept",
        "t_min",
        "t_max",
    )
    fixed = [*by, "coef", "intercept", "t_min", "t_max"]
    before = None
    for _ in range(max_iter):
        rows = counts.join(state, by)
        rows = rows.selectExpr("*", "1 / (1 + exp(-(coef * t + intercept))) AS p")
        rows = rows.selectExpr("*", "answers * p - correct AS r", "answers * p * (1 - p) AS w")
        sums = rows.groupBy(*fixed).agg(
            F.expr(f"sum(r * t) + {l0} * coef AS g0"),
            F.expr(f"sum(r) + {l1} * intercept AS g1"),
            F.expr(f"sum(w * t * t) + {l0} AS h00"),
            F.expr("sum(w * t) AS h01"),
            F.expr(f"sum(w) + {l1} AS h11"),
        )
        steps = sums.selectExpr(
            "*",
            "(h11 * g0 - h01 * g1) / nullif(h00 * h11 - h01 * h01, 0.0D) AS step0",
            "(h00 * g1 - h01 * g0) / nullif(h00 * h11 - h01 * h01, 0.0D) AS step1",
        ).selectExpr("*", "greatest(abs(step0 * t_min + step1), abs(step0 * t_max + step1)) AS moved")
        # No step moves the log odds at either end of the data by more than 4.
        steps = steps.selectExpr("*", "least(1.0D, 4.0D / greatest(moved, 1e-300D)) AS damping")
        solved, path = written(
            steps.selectExpr(
                *by,
                "coef - damping * step0 AS coef",
                "intercept - damping * step1 AS intercept",
                "t_min",
                "t_max",
                "h00",
                "h01",
                "h11",
                "moved",
            ),
            "newton-state",
        )
        worst = solved.agg(F.max("moved")).first()[0]
        state = solved.select(*fixed)
        if before:
            discard(counts.sparkSession, before)
        before = path
        if worst is None or worst < tolerance:
            break
    fitted = solved.select(*by, "coef", "intercept", "h00", "h01", "h11", (F.col("moved") < tolerance).alias("converged"))
    return cells.drop("correct").join(fitted, by, "left")


def logistic_fit(keys: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """L2-penalised (C = 1) logistic regression of is_correct on log10 of the frequency:
    ``by, coef, intercept, answers, t_min, t_max, converged`` (NULL where there is no fit)."""
    fit = newton_fit(sufficient_counts(keys, F.log10("frequency"), by), by)
    return fit.select(*by, "coef", "intercept", "answers", "t_min", "t_max", "converged")


def _grid(first: Column, last: Column, points: int) -> tuple[Column, Column]:
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    return i, first + (last - first) * F.col("point") / F.lit(float(max(points - 1, 1)))


def logistic_curve(fit: DataFrame, by: Sequence[str] = CELL, points: int = 10_000) -> DataFrame:
    """The fitted curve on an even grid in log10 of the frequency: ``by, point, frequency,
    probability``."""
    index, t = _grid(F.col("t_min"), F.col("t_max"), points)
    rows = fit.select(*by, "coef", "intercept", "t_min", "t_max", index).withColumn("t", t)
    odds = F.exp(-F.col("coef") * F.col("t") - F.col("intercept"))
    return rows.select(*by, "point", F.pow(F.lit(10.0), "t").alias("frequency"), (1 / (1 + odds)).alias("probability"))


# ---------------------------------------------------------------- Bayesian fit

PRIOR_PRECISION = 0.001  # fixed value, of both coefficients
LEVELS_PER_TASK = 20_000
CACHED = 4_096  # draws whose likelihoods are added up together
CHAINS = 4
_SPREAD = 5.0  # degrees of freedom of the proposals


def _cell_seed(cell: tuple, seed: int) -> int:
    return zlib.crc32(repr((seed, *map(str, cell))).encode())


def _proposals(row, rng: np.random.Generator, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws around the posterior mean (multivariate t, so heavier-tailed than the posterior) and their
    log density up to a constant. The first draw is the mode."""
    root = np.linalg.cholesky(np.array([[row.v00, row.v01], [row.v01, row.v11]]))
    mean = np.array([row.m0, row.m1])
    z = rng.standard_normal((draws, 2))
    z /= np.sqrt(rng.chisquare(_SPREAD, draws) / _SPREAD)[:, None]
    z[0] = np.linalg.solve(root, np.array([row.mode0, row.mode1]) - mean)
    density = -(_SPREAD + 2) / 2 * np.log1p((z * z).sum(axis=1) / _SPREAD)
    return mean + z @ root.T, density


def _nodes_needed(slope: np.ndarray, answers: float) -> np.ndarray:
    """Chebyshev nodes that ln(1 + exp(slope x + b)) takes on [-1, 1] so that ``answers`` of it are right to 1e-9.

    Its nearest singularity lies pi / slope from the real axis, so the error falls by ``rho`` with every node.
    """
    apart = np.pi / np.maximum(slope, 1e-9)
    rho = apart + np.sqrt(1 + apart * apart)
    return np.maximum(1, np.ceil((np.log(answers * 1e9) + np.log(4 / (1 - 1 / rho))) / np.log(rho)))


def _condensed(t: np.ndarray, n: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights whose weighted sum of a smooth function is that over the levels ``t`` weighted by ``n``."""
    half, middle = (t.max() - t.min()) / 2, (t.max() + t.min()) / 2
    angles = np.arccos(np.clip((t - middle) / half, -1, 1))
    moments = np.array([(n * np.cos(k * angles)).sum() for k in range(nodes)])
    moments[0] /= 2
    at = (np.arange(nodes) + 0.5) * np.pi / nodes
    return middle + half * np.cos(at), 2 / nodes * (np.cos(np.outer(at, np.arange(nodes))) @ moments)


def _softplus_sums(a: np.ndarray, b: np.ndarray, t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of n ln(1 + exp(a t + b)) over the levels, for every draw; in place, for as many as stay in the cache."""
    eta, part, total = np.empty_like(a), np.empty_like(a), np.zeros_like(a)
    for level, answers in zip(t, n):
        np.multiply(a, level, out=eta)
        eta += b
        np.abs(eta, out=part)
        np.negative(part, out=part)
        np.exp(part, out=part)
        part += 1.0
        np.log(part, out=part)
        np.maximum(eta, 0.0, out=eta)
        part += eta
        part *= answers
        total += part
    return total


class _Chains:
    """What the tasks of a fit share: the cell columns, the draws, the number of chains, and the seed."""

    def __init__(self, by: list[str], draws: int, burn: int, thin: int, seed: int, chains: int):
        self.by, self.draws, self.burn, self.thin, self.seed, self.chains = by, draws, burn, thin, seed, chains

    def cell(self, rows: pd.DataFrame) -> tuple:
        return tuple(rows.iloc[0][c] for c in self.by)

    def log_likelihood(self, rows: pd.DataFrame) -> np.ndarray:
        """Of all proposals, over some levels of a cell."""
        rng = np.random.default_rng(_cell_seed(self.cell(rows), self.seed))
        proposed, _ = _proposals(rows.iloc[0], rng, self.draws)
        t, n, k = (rows[c].to_numpy(float) for c in ("t", "answers", "correct"))
        # The right answers enter by two sums; all answers add n ln(1 + exp(eta)) per level.
        ll = proposed[:, 0] * (k * t).sum() + proposed[:, 1] * k.sum()
        needed = _nodes_needed(np.abs(proposed[:, 0]) * (t.max() - t.min()) / 2, n.sum())
        least = 0
        for most in (16, 32, 64, 128, 256, 512, np.inf):
            own = np.flatnonzero((needed > least) & (needed <= most))
            at, weight = _condensed(t, n, most) if most < len(t) else (t, n)
            for lo in range(0, len(own), CACHED):
                some = own[lo : lo + CACHED]
                ll[some] -= _softplus_sums(proposed[some, 0], proposed[some, 1], at, weight)
            least = most
        return ll

    def walk(self, rows: pd.DataFrame, ll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept states of all chains, coef and intercept, and the chain of each."""
        rng = np.random.default_rng(_cell_seed(self.cell(rows), self.seed))
        proposed, density = _proposals(rows.iloc[0], rng, self.draws)
        weight = (ll - PRIOR_PRECISION / 2 * (proposed**2).sum(axis=1) - density).tolist()
        log_u = np.log(rng.random(self.draws)).tolist()
        each, burn = self.draws // self.chains, self.burn // self.chains
        kept, chain = [], []
        for c in range(self.chains):
            here, state = c * each, []
            for i in range(c * each, (c + 1) * each):
                if log_u[i] < weight[i] - weight[here]:
                    here = i
                state.append(here)
            kept += state[burn :: self.thin]
            chain += [c] * len(state[burn :: self.thin])
        return proposed[kept], np.array(chain, np.int32)


# ---------------------------------------------------------------- quadrature of the posterior

NODES = 12  # nodes of an axis on either side of its middle
COARSE, FINE = 0.365, 0.25  # step of the axis before it is stretched by sinh


def _whitened(centre: DataFrame) -> DataFrame:
    """``centre`` with the triangular root of its covariance."""
    return centre.withColumn("l00", F.sqrt("v00")).withColumn("l10", F.expr("v01 / l00")).withColumn("l11", F.expr("sqrt(v11 - l10 * l10)"))


def _weighed(counts: DataFrame, centre: DataFrame, by: list[str], step: float) -> DataFrame:
    """``by, d0, d1, weight`` and the columns of ``centre``: nodes of a grid around the centre, as far from it as
    ``d0`` (coef) and ``d1`` (intercept), with their share of the posterior mass.

    The axes follow the covariance and are stretched by sinh, so they are fine near the centre and reach
    10 (``FINE``) or 40 (``COARSE``) spreads. Each level of a cell meets the nodes where it is read; their sums are
    combined before they are shuffled.
    """
    axis = F.sequence(F.lit(-NODES), F.lit(NODES))
    fixed = ["m0", "m1", "v00", "v01", "v11", "mode0", "mode1", "t_min", "t_max"]
    rows = counts.join(_whitened(centre), by).withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    rows = rows.selectExpr(*by, "i", "j", "t", "answers", "correct",
        f"m0 + l00 * sinh(i * {step!r}D) AS a", f"m1 + l10 * sinh(i * {step!r}D) + l11 * sinh(j * {step!r}D) AS b")
    rows = rows.selectExpr("*", "a * t + b AS eta")
    sums = rows.groupBy(*by, "i", "j").agg(F.expr("sum(correct * eta - answers * (greatest(eta, 0D) + ln(1 + exp(-abs(eta)))))").alias("ll"))
    sums = sums.join(_whitened(centre), by).selectExpr(*by, *fixed, "ll", "i", "j", f"l00 * sinh(i * {step!r}D) AS d0",
        f"l10 * sinh(i * {step!r}D) + l11 * sinh(j * {step!r}D) AS d1")
    sums = sums.withColumn("lp", F.expr(f"ll - {PRIOR_PRECISION / 2!r}D * ((m0 + d0) * (m0 + d0) + (m1 + d1) * (m1 + d1))"))
    sums = materialise(sums, "posterior-nodes")
    top = sums.groupBy(*by).agg(F.max("lp").alias("top"))
    rows = sums.join(top, by).withColumn("w", F.expr(f"exp(lp - top) * cosh(i * {step!r}D) * cosh(j * {step!r}D)"))
    total = rows.groupBy(*by).agg(F.sum("w").alias("total"))
    return rows.join(total, by).selectExpr(*by, *fixed, "d0", "d1", "w / total AS weight")


def posterior_moments(nodes: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """``by, m0, m1, v00, v01, v11``: mean and covariance of coef and intercept, and ``mode0, mode1, t_min, t_max``."""
    mean = nodes.groupBy(*by, "m0", "m1", "mode0", "mode1", "t_min", "t_max").agg(
        F.expr("sum(weight * d0)").alias("e0"), F.expr("sum(weight * d1)").alias("e1"),
        *[F.expr(f"sum(weight * d{p} * d{q})").alias(f"s{p}{q}") for p, q in ("00", "01", "11")],
    )
    return mean.selectExpr(*by, "m0 + e0 AS m0", "m1 + e1 AS m1", "s00 - e0 * e0 AS v00", "s01 - e0 * e1 AS v01",
        "s11 - e1 * e1 AS v11", "mode0", "mode1", "t_min", "t_max")


def posterior_nodes(keys: DataFrame, by: Sequence[str] = CELL, frequency: str = "frequency") -> DataFrame:
    """The posterior of every cell on a grid of its own: ``by, d0, d1, weight`` around ``m0, m1`` (coef, intercept).

    A wide grid at the mode, scaled by the curvature there, gives the mean and the spread of the posterior; the
    grid that is returned stands at that mean and follows that spread. Weights of a cell add up to one.
    """
    by = list(by)
    counts = materialise(sufficient_counts(keys, F.ln(frequency), by), "bayes-counts")
    fit = newton_fit(counts, by, (PRIOR_PRECISION, PRIOR_PRECISION))
    det = "(h00 * h11 - h01 * h01)"
    mode = fit.selectExpr(*by, "coef AS m0", "intercept AS m1", f"h11 / {det} AS v00", f"-h01 / {det} AS v01", f"h00 / {det} AS v11",
        "coef AS mode0", "intercept AS mode1", "t_min", "t_max")
    centre = materialise(posterior_moments(_weighed(counts, mode, by, COARSE), by), "posterior-centre")
    return materialise(_weighed(counts, centre, by, FINE), "posterior-fine")


BAND = {"low": 0.025, "high": 0.975}


def quadrature_band(
    nodes: DataFrame, by: Sequence[str] = CELL, points: int = 100, shares: Mapping[str, float] = MappingProxyType(BAND)
) -> DataFrame:
    """Mean curve and quantiles of ``posterior_nodes`` on the grid of ``posterior_band``: ``by, point, frequency,
    mean`` and a column for each of ``shares``, by default ``low, high``. A quantile lies between the two nodes
    whose middles of mass enclose its share. A group holds the nodes of a cell, (2 NODES + 1)^2 at most."""
    by, shares = list(by), dict(shares)

    def band(cell: pd.DataFrame) -> pd.DataFrame:
        first = cell.iloc[0]
        t = np.linspace(first.t_min - 5, first.t_max + 5, points)
        a, b, w = (first.m0 + cell.d0).to_numpy(), (first.m1 + cell.d1).to_numpy(), cell.weight.to_numpy()
        mean, edges = np.empty(points), np.empty((points, len(shares)))
        for k in range(points):
            eta = a * t[k] + b
            order = np.argsort(eta, kind="stable")
            mass = w[order]
            mean[k] = (w / (1 + np.exp(-np.clip(eta, -700, 700)))).sum()
            edges[k] = np.interp(list(shares.values()), np.cumsum(mass) - mass / 2, eta[order])
        p = 1 / (1 + np.exp(-np.clip(edges.T, -700, 700)))
        own = {"point": np.arange(points, dtype=np.int32), "frequency": np.exp(t), "mean": mean, **dict(zip(shares, p))}
        return pd.DataFrame({**{c: first[c] for c in by}, **own})

    fields = [T.StructField("point", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("frequency", "mean", *shares)]
    return nodes.groupBy(*by).applyInPandas(band, T.StructType([*[nodes.schema[c] for c in by], *fields]))


# ---------------------------------------------------------------- chains


def _part_likelihoods(rows: DataFrame, chains: _Chains) -> DataFrame:
    """The log likelihood of every proposal, as arrays of DRAWS_PER_ROW, for cells with many levels.

    A cell is cut into parts of about LEVELS_PER_TASK levels, whose arrays are summed place by place, so a
    task holds the arrays of one part or the sum.
    """
    by = chains.by

    def part_sums(rows: pd.DataFrame) -> pd.DataFrame:
        ll = chains.log_likelihood(rows)
        blocks = range(0, len(ll), DRAWS_PER_ROW)
        return pd.DataFrame(
            {
                **{c: [v] * len(blocks) for c, v in zip(by, chains.cell(rows))},
                "block": list(blocks),
                "ll": [ll[lo : lo + DRAWS_PER_ROW] for lo in blocks],
            }
        )

    parts = F.ceil(F.col("levels") / LEVELS_PER_TASK)
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("block", T.LongType()), T.StructField("ll", T.ArrayType(T.DoubleType()))])
    partial = rows.withColumn("part", F.pmod(F.xxhash64("t"), parts)).groupBy(*by, "part").applyInPandas(part_sums, schema)
    numbered = partial.select(*by, "block", F.posexplode("ll").alias("place", "value"))
    summed = numbered.groupBy(*by, "block", "place").agg(F.sum("value").alias("value"))
    listed = summed.groupBy(*by, "block").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("ll"))
    return listed.withColumn("ll", F.col("ll.value"))


DRAWS_PER_ROW = 10_000


def _per_cell(keys: DataFrame, chains: _Chains, frequency: str, nodes: DataFrame | None, result, fields: list[T.StructField]):
    """``result`` of the chains of every cell. Cells of up to LEVELS_PER_TASK levels, the common case, are evaluated
    and walked in one task; of the others a task evaluates a part, and another walks the sums."""
    by = chains.by
    counts = materialise(sufficient_counts(keys, F.ln(frequency), by), "bayes-counts")
    nodes = posterior_nodes(keys, by, frequency) if nodes is None else nodes
    levels = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("levels"))
    fit = materialise(posterior_moments(nodes, by).join(levels, by), "bayes-moments")
    rows = counts.join(fit, by)

    def told(group: pd.DataFrame, ll: np.ndarray) -> pd.DataFrame:
        kept, chain = chains.walk(group, ll)
        return pd.DataFrame({**dict(zip(by, chains.cell(group))), **result(group.iloc[0], kept, chain)})

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        return told(group, chains.log_likelihood(group))

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        return told(group, np.concatenate([np.asarray(x) for x in group.ll]))

    schema = T.StructType([*[rows.schema[c] for c in by], *fields])
    few = rows.where(F.col("levels") <= LEVELS_PER_TASK).groupBy(*by).applyInPandas(whole, schema)
    many = _part_likelihoods(rows.where(F.col("levels") > LEVELS_PER_TASK), chains).join(fit, by)
    return few.unionByName(many.groupBy(*by).applyInPandas(summed, schema))


def bayes_logistic(
    keys: DataFrame,
    by: Sequence[str] = CELL,
    draws: int = 120_000,
    burn: int = 100_000,
    thin: int = 2,
    seed: int = 0,
    frequency: str = "frequency",
    chains: int = CHAINS,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """Posterior samples of ``P(correct) = 1 / (1 + exp(beta t + alpha))`` with t = ln frequency
    and normal priors: ``by, chain, half, draw, beta, alpha, t_min, t_max``.

    ``chains`` Metropolis chains per cell share the draws and the burn-in; the first starts at the mode. ``half``
    is the half of its chain that a sample belongs to, for ``chain_diagnostics``. Proposals have the mean and the
    covariance of ``nodes`` (by default ``posterior_nodes`` of the same keys) and do not depend on the state of
    a chain, so the log likelihood of all of them is computed over the parts of the count table first; the
    chains then read ``draws`` numbers per cell. Note that beta has the opposite sign of ``coef``.
    """

    def samples(first, kept: np.ndarray, chain: np.ndarray) -> dict:
        each = len(kept) // chains
        return {
            "chain": chain,
            "half": (np.arange(len(kept)) % each * 2 // each).astype(np.int32),
            "draw": np.arange(len(kept), dtype=np.int64),
            "beta": -kept[:, 0],
            "alpha": -kept[:, 1],
            "t_min": first.t_min,
            "t_max": first.t_max,
        }

    fields = [T.StructField("chain", T.IntegerType()), T.StructField("half", T.IntegerType()), T.StructField("draw", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("beta", "alpha", "t_min", "t_max")]
    return _per_cell(keys, _Chains(list(by), draws, burn, thin, seed, chains), frequency, nodes, samples, fields)


BATCH = 50  # draws of a batch for the effective sample size


def chain_diagnostics(samples: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """``by, samples`` and for beta and alpha ``<name>_mean, <name>_sd, <name>_rhat, <name>_ess``.

    Split R-hat compares the spread between half chains with that within them. The effective sample size
    follows from the spread of the means of batches of ``BATCH`` draws. Both come from counts, means and
    variances of batches, which are combined upwards: batches, half chains, cells.
    """
    by = list(by)
    names = ("beta", "alpha")
    batch = (F.col("draw") / BATCH).cast("bigint").alias("batch")
    rows = samples.select(*by, "chain", "half", batch, *names).groupBy(*by, "chain", "half", "batch")
    rows = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{k}") for c in names for k, f in (("m", F.avg), ("v", F.var_pop))])
    wide = {c: F.expr(f"sum(n * {c}_m) / sum(n)") for c in names}
    halves = rows.groupBy(*by, "chain", "half").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("batches"),
        *[e.alias(f"{c}_m") for c, e in wide.items()],
        # Spread within batches, and of their means, around the mean of the first level.
        *[F.expr(f"sum(n * {c}_v) / sum(n) + var_pop({c}_m)").alias(f"{c}_v") for c in names],
        *[F.expr(f"sum(n) / count(1) * var_samp({c}_m)").alias(f"{c}_b") for c in names],
    )
    out = [F.sum("n").alias("samples")]
    for c in names:
        within, between = f"avg({c}_v)", f"var_samp({c}_m)"
        out += [
            F.expr(f"sum(n * {c}_m) / sum(n)").alias(f"{c}_mean"),
            F.expr(f"sqrt({within} + var_pop({c}_m))").alias(f"{c}_sd"),
            F.expr(f"sqrt(({within} + {between}) / {within})").alias(f"{c}_rhat"),
            F.expr(f"sum(n) * {within} / avg({c}_b)").alias(f"{c}_ess"),
        ]
    return halves.groupBy(*by).agg(*out)


def bayes_band(
    keys: DataFrame,
    by: Sequence[str] = CELL,
    draws: int = 120_000,
    burn: int = 100_000,
    thin: int = 2,
    seed: int = 0,
    frequency: str = "frequency",
    points: int = 100,
    chains: int = CHAINS,
    nodes: DataFrame | None = None,
) -> DataFrame:
    """``posterior_band`` of ``bayes_logistic``, evaluated where the chain was walked: the samples
    of a cell, bounded by the draws, do not leave their task."""

    def band(first, kept: np.ndarray, chain: np.ndarray) -> dict:
        t = np.linspace(first.t_min - 5, first.t_max + 5, points)
        p = 1 / (1 + np.exp(-np.clip(kept[:, :1] * t + kept[:, 1:], -700, 700)))
        p.sort(axis=0)
        n = len(p)

        def quantile(share: float) -> np.ndarray:
            place = n * share + (0.4 + 0.2 * share)
            k = int(np.floor(min(max(place, 1.0), max(n - 1, 1))))
            part = min(max(place - k, 0.0), 1.0)
            return (1 - part) * p[k - 1] + part * p[min(k, n - 1)]

        return {
            "point": np.arange(points, dtype=np.int32),
            "frequency": np.exp(t),
            "mean": p.mean(axis=0),
            "low": quantile(0.025),
            "high": quantile(0.975),
        }

    fields = [T.StructField("point", T.IntegerType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("frequency", "mean", "low", "high")]
    return _per_cell(keys, _Chains(list(by), draws, burn, thin, seed, chains), frequency, nodes, band, fields)


def posterior_band(samples: DataFrame, by: Sequence[str] = CELL, points: int = 100) -> DataFrame:
    """Mean curve and 95% band of the posterior on an even grid of t, 5 beyond the data on both
    sides: ``by, point, frequency, mean, low, high``. The quantiles use plotting positions
    (0.4, 0.4). A list holds one number per kept draw."""
    by = list(by)
    index, t = _grid(F.col("t_min") - 5, F.col("t_max") + 5, points)
    rows = samples.select(*by, "beta", "alpha", "t_min", "t_max", index).withColumn("t", t)
    p = 1 / (1 + F.exp(F.col("beta") * F.col("t") + F.col("alpha")))
    bands = rows.groupBy(*by, "point", "t").agg(
        F.avg(p).alias("mean"), F.array_sort(F.collect_list(p)).alias("values")
    )

    def quantile(share: float) -> Column:
        n = F.size("values")
        place = n * share + (0.4 + 0.2 * share)
        k = F.floor(F.least(F.greatest(place, F.lit(1.0)), F.greatest(n - 1, F.lit(1)).cast("double"))).cast("int")
        part = F.least(F.greatest(place - k, F.lit(0.0)), F.lit(1.0))
        low = F.get("values", k - 1)
        return (1 - part) * low + part * F.coalesce(F.get("values", k), low)

    return bands.select(
        *by,
        "point",
        F.exp("t").alias("frequency"),
        "mean",
        quantile(0.025).alias("low"),
        quantile(0.975).alias("high"),
    )
