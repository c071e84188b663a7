"""Small fixed dimensions of the experiments. All entries are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# factory type: (math operator, word in the question)
FACTORIES = {
    "Num1Mult": ("*", "times"),
    "Num2Mult": ("*", "times"),
    "Num1#*": ("*", "#"),
    "Num2#*": ("*", "#"),
    "Num1Plus": ("+", "plus"),
    "Num2Plus": ("+", "plus"),
    "Num1#+": ("+", "#"),
    "Num2#+": ("+", "#"),
    "Num1concat#": ("concat", "#"),
    "Num1mode10#": ("%", "#"),
    "Num1Less": ("comp", "lower"),
    "Num1More": ("comp", "higher"),
    "Num1MoreLess": ("comp", "higherlower"),
}

# unit: (multiplier, unit of the result)
UNITS = {
    "minute": (60, "seconds"),
    "hour": (60, "minutes"),
    "day": (24, "hours"),
    "week": (7, "days"),
    "month": (4, "weeks"),
    "year": (12, "months"),
    "decade": (10, "years"),
}

# Experiment words whose frequency keys carry no unit word.
NO_WORD_KEYS = (
    "mult",
    "plus",
    "concat",
    "plushashtag",
    "multhashtag",
    "mode10hashtag",
    "compareless",
    "comparemore",
    "comparemoreless",
)

MODE_LABELS = {
    "mult": "Arithmetics-Multiplication",
    "plus": "Arithmetics-Adding",
    "concat": "Numbers-Concatination",
    "mode10hashtag": "Numbers-Mode10#",
    "plushashtag": "Numbers-Add#",
    "multhashtag": "Numbers-Mult#",
    "compareless": "Numbers-lower",
    "comparemore": "Numbers-higher",
}
MODEL_LABELS = {"gptjsmall": "1.3B", "gptjlarge": "2.7B", "gptj": "6B"}
MODEL_NAMES = {"gptjsmall": "GPT-NEO-1.3B", "gptjlarge": "GPT-NEO-2.7B", "gptj": "GPT-J-6B"}

# experiment word: task name in reports
ARITHMETIC_TASKS = {"mult": "Multiplication", "plus": "Addition"}
ABSTRACT_TASKS = {"multhashtag": "Multiplication", "plushashtag": "Addition"}
COMPARISON_TASKS = {"compareless": "Min", "comparemore": "Max"}
TIME_TASKS = {
    "minute": "Min2Sec",
    "hour": "Hour2Min",
    "day": "Day2Hour",
    "week": "Week2Day",
    "month": "Month2Week",
    "year": "Year2Month",
    "decade": "Decade2Year",
}

# keyword: file name of its counts, where the keyword itself cannot be one
KEYWORD_FILES = {"*": "sign_multiply", "+": "sign_plus", "-": "sign_minus"}


def lookup(column: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """CASE expression for a small table; NULL or ``default`` for other values."""
    result = None
    for key, value in table.items():
        result = F.when(column == key, value) if result is None else result.when(column == key, value)
    return result if default is None else result.otherwise(default)


def factory_dimension(spark: SparkSession) -> DataFrame:
    rows = [(f, operator, word) for f, (operator, word) in FACTORIES.items()]
    return spark.createDataFrame(rows, "factory_type string, math_operator string, word string")


def unit_dimension(spark: SparkSession) -> DataFrame:
    rows = [(u, multiplier, f"{u}s", target) for u, (multiplier, target) in UNITS.items()]
    return spark.createDataFrame(rows, "unit string, multiplier long, source string, target string")


def mode_label(word: Column) -> Column:
    return lookup(word, MODE_LABELS, F.concat(F.lit("Time-Coversion-From-"), word))


def short_mode_label(word: Column) -> Column:
    """Labels of the single-experiment summary, which knows two arithmetic modes."""
    names = {w: MODE_LABELS[w] for w in ("mult", "plus")}
    return lookup(word, names, F.concat(F.lit("Time-Coversion-From"), word))


def model_label(model: Column) -> Column:
    return lookup(model, MODEL_LABELS)


def model_name(model: Column) -> Column:
    return lookup(model, MODEL_NAMES)
