"""Accuracy against frequency: quantile bins, intervals, curves and correlations.

Input is the output of ``key_accuracy``: one row per cell (the ``by`` columns) and key, with
``frequency`` and ``accuracy``. All cells are handled in one job. Keys are first summed per
distinct value, and ranks come from sums per value bucket and then within buckets, so no task
sorts a whole cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgauge.functions import stats
from termgauge.session import materialise

CELL = ("word", "model", "shots", "key_type")


def cumulative(levels: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Adds ``below`` (weight of smaller values) and ``total`` (weight of the cell) to a table
    with one row per cell and distinct value."""
    by = list(by)
    rows = levels.withColumn("bucket", stats.value_bucket(F.col(value)))
    per_bucket = rows.groupBy(*by, "bucket").agg(F.sum(weight).alias("_w"))
    earlier = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *by,
        "bucket",
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_w").over(Window.partitionBy(*by)).alias("total"),
    )
    smaller = Window.partitionBy(*by, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets, [*by, "bucket"])
    below = F.col("_before") + F.coalesce(F.sum(weight).over(smaller), F.lit(0))
    return joined.withColumn("below", below).drop("bucket", "_before")


def _levels(keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys summed per distinct frequency."""
    return keys.groupBy(*by, "frequency").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("accuracy").alias("s1"),
        F.sum(F.col("accuracy") * F.col("accuracy")).alias("s2"),
    )


def frequency_quantiles(keys: DataFrame, q: int = 10, by: Sequence[str] = CELL) -> DataFrame:
    """``by, edges``: the q+1 linearly interpolated quantiles of the key frequencies, the last
    one raised by 1 so that the largest frequency falls below it."""
    levels = keys.groupBy(*by, "frequency").agg(F.count(F.lit(1)).alias("keys"))
    rows = cumulative(levels, by, "frequency", "keys")
    # SQL text, because the same few terms repeat for every edge.
    shares = [i * (1.0 / q) for i in range(q)] + [1.0]
    places = [f"((total - 1) * {share!r}D)" for share in shares]

    def value_at(place: str) -> str:
        # Exactly one level spans the rank.
        return f"max(CASE WHEN below <= {place} AND {place} < below + keys THEN frequency END)"

    picked = rows.groupBy(*by, "total").agg(
        *[F.expr(f"{value_at(f'floor({p})')} AS lo{i}") for i, p in enumerate(places)],
        *[F.expr(f"{value_at(f'least(floor({p}) + 1, total - 1)')} AS hi{i}") for i, p in enumerate(places)],
    )
    edges = [stats.lerp_sql(f"lo{i}", f"hi{i}", f"({p} - floor({p}))") for i, p in enumerate(places)]
    edges[-1] += " + 1.0D"
    return picked.selectExpr(*by, f"array({', '.join(edges)}) AS edges")


def bin_table(keys: DataFrame, q: int = 10, by: Sequence[str] = CELL) -> DataFrame:
    """One row per cell and quantile bin 1..q.

    ``keys`` in the bin, mean ``accuracy``, 95% half-width ``h``, edges ``low`` and ``high``,
    ``width``, geometric ``mid`` and ``dilated`` interpolation point. Empty bins before the
    first filled one have accuracy and h 0, later empty ones NULL; h is NULL for one key.
    """
    by = list(by)
    edges = frequency_quantiles(keys, q, by)
    binned = _levels(keys, by).join(edges, by)
    binned = binned.withColumn("bin", F.expr("size(filter(edges, e -> e <= frequency))"))
    summed = binned.groupBy(*by, "bin").agg(
        F.sum("keys").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.any_value("edges").alias("edges")
    )
    stats_of_bin = F.expr("""struct(bin, n, s1 / n AS mean,
        CASE WHEN n > 1 THEN sqrt(greatest(s2 - s1 * s1 / n, 0.0D) / (n - 1)) / sqrt(n) END AS sem)""")
    # At most q filled bins per cell; the empty ones are added from the sequence.
    cells = summed.groupBy(*by).agg(F.any_value("edges").alias("edges"), F.collect_list(stats_of_bin).alias("filled"))
    rows = cells.select(*by, "edges", "filled", F.explode(F.sequence(F.lit(1), F.lit(q))).alias("bin"))
    rows = rows.selectExpr(
        *by,
        "bin",
        "get(filter(filled, s -> s.bin = bin), 0) AS found",
        "bin < array_min(filled.bin) AS leading",
        "get(edges, bin - 1) AS low",
        "get(edges, bin) AS high",
    ).selectExpr(*by, "bin", "leading", "low", "high", "found.n", "found.mean", "found.sem")
    t = f"((bin - 1) / {float(max(q - 1, 1))!r}D)"
    return rows.selectExpr(
        *by,
        "bin",
        "coalesce(n, 0) AS keys",
        "CASE WHEN leading THEN 0.0D ELSE mean END AS accuracy",
        f"CASE WHEN leading THEN 0.0D ELSE sem * {stats.t_975_sql('(n - 1)')} END AS h",
        "low",
        "high",
        "high - low AS width",
        "sqrt(low * high) AS mid",
        f"exp((1 - {t}) * ln(low) + {t} * ln(high)) AS dilated",
    )


def bin_accuracy(keys: DataFrame, q: int = 10, by: Sequence[str] = CELL) -> DataFrame:
    return bin_table(keys, q, by).select(*by, "bin", "keys", "accuracy")


def bin_confidence(keys: DataFrame, q: int = 10, by: Sequence[str] = CELL) -> DataFrame:
    return bin_table(keys, q, by).select(*by, "bin", "h")


def bin_geometry(keys: DataFrame, q: int = 10, by: Sequence[str] = CELL) -> DataFrame:
    return bin_table(keys, q, by).select(*by, "bin", "low", "high", "width", "mid", "dilated")


def extrapolated_curve(bins: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Curve through the bin mids, extended to the outer edges along log x: ``by, point,
    frequency, accuracy, h`` with points 0..q+1. The list per cell has q entries."""
    by = list(by)
    listed = F.array_sort(F.collect_list(F.struct("bin", "mid", "accuracy", "h", "low", "high")))
    cells = bins.groupBy(*by).agg(listed.alias("b")).withColumn("q", F.size("b"))
    at = lambda i, field: F.get("b", F.lit(i) if isinstance(i, int) else i).getField(field)
    last, second_last = F.col("q") - 1, F.col("q") - 2

    def beyond(edge: Column, i, j) -> Column:
        run = F.ln(at(j, "mid")) - F.ln(at(i, "mid"))
        slope = (at(j, "accuracy") - at(i, "accuracy")) / F.nullif(run, F.lit(0.0))
        return slope * F.ln(edge) + (at(i, "accuracy") - slope * F.ln(at(i, "mid")))

    def point(place, frequency, accuracy, h) -> Column:
        return F.struct(
            place.cast("int").alias("point"),
            frequency.alias("frequency"),
            accuracy.alias("accuracy"),
            h.alias("h"),
        )

    left, right = at(0, "low"), at(last, "high")
    points = F.concat(
        F.array(point(F.lit(0), left, beyond(left, 0, 1), at(0, "h"))),
        F.transform("b", lambda s: point(s.bin, s.mid, s.accuracy, s.h)),
        F.array(point(F.col("q") + 1, right, beyond(right, second_last, last), at(last, "h"))),
    )
    return cells.select(*by, F.inline(points))


def performance_gap(bins: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Accuracy of the first and the last bin and their difference ``gap``."""
    rows = bins.groupBy(*by).agg(
        F.min_by("accuracy", "bin").alias("q_first"), F.max_by("accuracy", "bin").alias("q_last")
    )
    return rows.withColumn("gap", F.col("q_last") - F.col("q_first"))


def _mean_ranks(points: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    levels = points.groupBy(*by, value).agg(F.sum("n").alias("ties"))
    ranks = cumulative(levels, by, value, "ties")
    return ranks.select(
        *by, value, (F.col("below") + (F.col("ties") + 1) / 2).alias(f"{value}_rank"), "total"
    )


def spearman_corr(keys: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Rank correlation of accuracy and frequency over the keys, ties at their mean rank."""
    by = list(by)
    points = keys.groupBy(*by, "frequency", "accuracy").agg(F.count(F.lit(1)).alias("n"))
    points = materialise(points, "spearman-points")  # read by three steps
    ranked = points.join(_mean_ranks(points, by, "frequency"), [*by, "frequency"]).join(
        _mean_ranks(points, by, "accuracy").drop("total"), [*by, "accuracy"]
    )
    centred = ranked.selectExpr(
        *by, "n", "frequency_rank - (total + 1) / 2 AS u", "accuracy_rank - (total + 1) / 2 AS v"
    )
    corr = "try_divide(sum(n * u * v), sqrt(sum(n * u * u)) * sqrt(sum(n * v * v)))"
    return centred.groupBy(*by).agg(F.expr(corr).alias("spearman"))


def pearson_log_corr(keys: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Correlation of accuracy and the logarithm of the frequency over the keys."""
    log_f = F.ln("frequency")
    scale = F.stddev_pop("accuracy") * F.stddev_pop(log_f)
    return keys.groupBy(*by).agg(F.try_divide(F.covar_pop("accuracy", log_f), scale).alias("pearson"))
