"""Grading completions and summing up accuracy per term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgauge.functions import text as tx


def grade_completions(rows: DataFrame) -> DataFrame:
    """Adds ``generated_answer`` and ``is_correct`` (0/1) to rows with ``body`` (the prompt),
    ``full_text`` (prompt and completion) and ``answer``.

    The answer given is the first token after the prompt and one more character; it counts
    only if it equals the expected one. An empty completion has a NULL answer and is wrong.
    """
    completion = F.expr("substring(full_text, length(body) + 2)")
    given = F.get(tx.tokenize(completion), F.lit(0))
    correct = F.coalesce(tx.strip(F.col("generated_answer")) == tx.strip(F.col("answer")), F.lit(False))
    return rows.withColumn("generated_answer", given).withColumn("is_correct", correct.cast("int"))


def accuracy_by_key(graded: DataFrame, by: tuple[str, ...] = ("seed",)) -> DataFrame:
    """Right answers, answers and accuracy per key and frequency."""
    return (
        graded.groupBy(*by, "key", "frequency")
        .agg(F.sum("is_correct").cast("bigint").alias("correct"), F.count(F.lit(1)).alias("total"))
        .withColumn("accuracy", F.col("correct") / F.col("total"))
    )


# Column names of result files and the flat names used everywhere else.
RESULT_COLUMNS = {
    "generated_answer": "generated_answer",
    "is_correct": "is_correct",
    "testcase.body": "body",
    "testcase.data_point.question": "question",
    "testcase.data_point.answer": "answer",
    "testcase.data_point.frequency_data.x": "x",
    "testcase.data_point.frequency_data.y": "y",
    "testcase.data_point.frequency_data.z": "z",
    "testcase.data_point.frequency_data.word": "word",
    "testcase.data_point.frequency_data.math_operator": "math_operator",
    "testcase.data_point.frequency_data.key": "key",
    "testcase.data_point.frequency_data.frequency": "frequency",
}


def nest_results(graded: DataFrame) -> DataFrame:
    """Graded rows as nested results: ``testcase`` (body, data_point), answer given, is_correct."""
    frequency_data = F.struct("x", "y", "z", "word", "math_operator", "key", "frequency")
    data_point = F.struct("question", "answer", frequency_data.alias("frequency_data"))
    others = [c for c in graded.columns if c not in RESULT_COLUMNS.values()]
    return graded.select(
        *others,
        F.struct("body", data_point.alias("data_point")).alias("testcase"),
        "generated_answer",
        F.col("is_correct").cast("boolean").alias("is_correct"),
    )


def flatten_results(nested: DataFrame) -> DataFrame:
    """Nested results as flat columns with dotted names."""
    others = [c for c in nested.columns if c not in ("testcase", "generated_answer", "is_correct")]
    return nested.select(*others, *[F.col(path).alias(path) for path in RESULT_COLUMNS])
