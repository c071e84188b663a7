"""Reports over many experiments. Word, model, shots and key type are grouping columns, so a
whole report is one job. Input is the ``key_accuracy`` table of all experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgauge.functions import dimensions as dims
from termgauge.operators import accuracy as acc
from termgauge.operators import lookup, models
from termgauge.session import materialise

EXPERIMENT = ("word", "model", "shots")


def _wanted(keys: DataFrame, words=None, model=None, shots=None, key_types=None) -> DataFrame:
    for column, values in (("word", words), ("model", model), ("shots", shots), ("key_type", key_types)):
        if values is not None:
            keys = keys.where(F.col(column).isin(list(values)))
    return keys


def _cells(keys: DataFrame, q: int) -> DataFrame:
    """Per cell: accuracy of all answers and of the first and last bin, and the gap."""
    gaps = acc.performance_gap(acc.bin_table(keys, q))
    return gaps.join(lookup.overall_accuracy(keys, acc.CELL), list(acc.CELL))


def _pivot(cells: DataFrame, key_types: Sequence[str], fields: Sequence[str]) -> DataFrame:
    value = lambda field, kt: F.max(F.when(F.col("key_type") == kt, F.col(field)))
    return cells.groupBy(*EXPERIMENT).agg(
        value("accuracy", "x").alias("accuracy"),
        *[value(f, kt).alias(f"{f}_{kt}") for kt in key_types for f in fields],
    )


def _gap_report(keys, tasks, models_, shots, key_types, q, fields) -> DataFrame:
    rows = _wanted(keys, tasks, models_, shots, key_types)
    report = _pivot(_cells(rows, q), key_types, fields)
    return report.select(dims.lookup(F.col("word"), tasks).alias("task"), *report.columns[1:])


def gap_report_arithmetic(keys: DataFrame, model=("gptj",), shots=None, q: int = 10) -> DataFrame:
    """Task, model, shots, accuracy and the gaps by x, xy and xz."""
    return _gap_report(keys, dims.ARITHMETIC_TASKS, model, shots, ("x", "xy", "xz"), q, ["gap"])


def gap_report_comparison(keys: DataFrame, model=("gptj",), shots=None, q: int = 10) -> DataFrame:
    return _gap_report(keys, dims.COMPARISON_TASKS, model, shots, ("x", "xy", "xz"), q, ["gap"])


def gap_report_timeunit(keys: DataFrame, model=("gptj",), shots=None, q: int = 10) -> DataFrame:
    """Like the others, without xz."""
    return _gap_report(keys, dims.TIME_TASKS, model, shots, ("x", "xy"), q, ["gap"])


def gap_report_full(keys: DataFrame, tasks: dict[str, str], model=("gptj",), shots=None, q: int = 10) -> DataFrame:
    """Also first and last bin per key type, and the gap relative to the accuracy."""
    report = _gap_report(
        keys, tasks, model, shots, ("x", "xy", "xz"), q, ["q_first", "q_last", "gap"]
    )
    base = F.nullif("accuracy", F.lit(0.0))
    return report.withColumns({f"ratio_{kt}": F.col(f"gap_{kt}") / base for kt in ("x", "xy")})


def gap_report_percent(keys: DataFrame, tasks: dict[str, str], model=("gptj",), shots=None, q: int = 10) -> DataFrame:
    """Accuracy and gaps in percent."""
    report = _gap_report(keys, tasks, model, shots, ("x", "xy", "xz"), q, ["gap"])
    percent = lambda c: (F.col(c) * 100).alias(c)
    return report.select(
        "task", "model", "shots", *[percent(c) for c in report.columns if c == "accuracy" or c.startswith("gap_")]
    )


def model_shot_error_bars(keys: DataFrame, key_type: str = "x", q: int = 10) -> DataFrame:
    """Accuracy per experiment with the distances to the first and the last bin."""
    cells = _cells(_wanted(keys, key_types=[key_type]), q)
    return cells.select(
        *EXPERIMENT,
        dims.model_label(F.col("model")).alias("model_label"),
        "accuracy",
        (F.col("accuracy") - F.col("q_first")).alias("error_lower"),
        (F.col("q_last") - F.col("accuracy")).alias("error_upper"),
    )


def _series_label(by: str, style: str) -> Column:
    shots, model = F.col("shots").cast("string"), dims.model_label(F.col("model"))
    if by == "models":
        return F.concat(F.lit("LM = "), model)
    if by == "shots":
        return F.concat(F.lit("shots = " if style == "logistic" else "k="), shots)
    if by == "both":
        return F.concat(F.lit("k="), shots, F.lit(", LM" if style == "logistic" else ", LM="), model)
    raise ValueError(f"series are by shots, models or both, not {by!r}")


def logistic_series_by(
    keys: DataFrame, by: str, words=None, model=None, shots=None, key_type: str = "x", points: int = 10_000
) -> DataFrame:
    """Fitted curve per experiment with its ``label``."""
    rows = _wanted(keys, words, model, shots, [key_type])
    curve = models.logistic_curve(models.logistic_fit(rows), points=points)
    return curve.withColumn("label", _series_label(by, "logistic"))


def interpolation_series_by(
    keys: DataFrame, by: str, words=None, model=None, shots=None, key_type: str = "x", q: int = 10
) -> DataFrame:
    """Interpolated curve with intervals per experiment and its ``label``."""
    rows = _wanted(keys, words, model, shots, [key_type])
    curve = acc.extrapolated_curve(acc.bin_table(rows, q))
    return curve.withColumn("label", _series_label(by, "interpolation"))


def freq_accuracy_series(keys: DataFrame, q: int = 10, points: int = 10_000) -> DataFrame:
    """All series of a frequency-accuracy figure: ``cell, series, point, frequency, value, low,
    high``. Series: bars (low and high are the edges), errors, interpolation, scatter, logistic,
    and the single values spearman and accuracy."""
    cell = list(acc.CELL)
    bins = materialise(acc.bin_table(keys, q), "bins")
    none = F.lit(None).cast("double")

    def series(rows, name, point, frequency, value, low=none, high=none):
        return rows.select(
            *cell,
            F.lit(name).alias("series"),
            point.cast("string").alias("point"),
            frequency.cast("double").alias("frequency"),
            value.cast("double").alias("value"),
            low.alias("low"),
            high.alias("high"),
        )

    c = F.col
    band = (c("accuracy") - c("h"), c("accuracy") + c("h"))
    nothing = F.lit(0)
    parts = [
        series(bins, "bars", c("bin"), c("low"), c("accuracy"), c("low"), c("high")),
        series(bins, "errors", c("bin"), c("mid"), c("accuracy"), *band),
        series(acc.extrapolated_curve(bins), "interpolation", c("point"), c("frequency"), c("accuracy"), *band),
        series(keys, "scatter", c("key"), c("frequency"), c("accuracy")),
        series(acc.spearman_corr(keys), "spearman", nothing, none, c("spearman")),
        series(lookup.overall_accuracy(keys, cell), "accuracy", nothing, none, c("accuracy")),
    ]
    if points:
        curve = models.logistic_curve(models.logistic_fit(keys), points=points)
        parts.append(series(curve, "logistic", c("point"), c("frequency"), c("probability")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def labels(experiments: DataFrame) -> DataFrame:
    """Display names of the experiments found in a table."""
    return experiments.select("word", "model").distinct().select(
        "word",
        "model",
        dims.mode_label(F.col("word")).alias("mode"),
        dims.short_mode_label(F.col("word")).alias("summary_mode"),
        dims.model_label(F.col("model")).alias("size"),
        dims.model_name(F.col("model")).alias("model_name"),
    )


def experiment_summary(keys: DataFrame, key_type: str = "xz") -> DataFrame:
    """Mode, shots and model with rank and log-linear correlation of accuracy and frequency."""
    rows = _wanted(keys, key_types=[key_type])
    both = acc.spearman_corr(rows).join(acc.pearson_log_corr(rows), list(acc.CELL))
    return both.select(
        dims.short_mode_label(F.col("word")).alias("mode"),
        "shots",
        dims.model_name(F.col("model")).alias("model"),
        "spearman",
        "pearson",
    )
