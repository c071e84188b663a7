"""Column expressions for statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 97.5% quantiles of Student's t for 1 to 29 degrees of freedom.
T_975 = (
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252,
    2.306004135, 2.262157163, 2.228138852, 2.200985160, 2.178812830, 2.160368656, 2.144786688,
    2.131449546, 2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447, 2.079613845,
    2.073873068, 2.068657610, 2.063898562, 2.059538553, 2.055529439, 2.051830516, 2.048407142,
    2.045229642,
)
Z_975 = 1.959963984540054  # fixed value: 97.5% quantile of the normal distribution


def t_975_sql(v: str) -> str:
    """SQL for the 97.5% quantile of Student's t with ``v`` degrees of freedom; NULL below 1.

    From 30 on a four-term expansion around the normal quantile, good to 3e-8. The text is
    valid in Spark and in DuckDB.
    """
    z = Z_975
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    d = f"CAST({v} AS DOUBLE)"
    series = f"CAST({z!r} AS DOUBLE)"
    for power, term in enumerate(terms, 1):
        series += f" + CAST({term!r} AS DOUBLE) / ({' * '.join([d] * power)})"
    cases = " ".join(f"WHEN {i} THEN CAST({t!r} AS DOUBLE)" for i, t in enumerate(T_975, 1))
    return f"(CASE WHEN {v} < 1 THEN NULL WHEN {v} >= 30 THEN {series} ELSE CASE {v} {cases} END END)"


def value_bucket(value: Column) -> Column:
    """A non-decreasing map of numbers to at most a few hundred thousand integers.

    256 buckets per power of two, on either side of zero. It depends on the value alone, so
    any two passes over the data agree on it.
    """
    scale = lambda v: F.floor(F.log2(v) * 256)
    return (
        F.when(value > 0, scale(value))
        .when(value == 0, F.lit(-1_000_000))
        .otherwise(F.lit(-2_000_000) - scale(-value))
        .cast("bigint")
    )


def lerp_sql(a: str, b: str, t: str) -> str:
    """SQL for the linear interpolation between ``a`` and ``b``, taken from the nearer end."""
    return f"CASE WHEN {t} < 0.5D THEN {a} + ({b} - {a}) * {t} ELSE {b} - ({b} - {a}) * (1 - {t}) END"
