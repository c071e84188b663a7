"""From frequent terms to questions: operands, filters and question texts.

``operand_expand`` gives ``factory_type, key, frequency, x, y, z, word, math_operator``, with
operands as strings. Operand ranges are exploded from literal sequences, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgauge.functions import dimensions as dims
from termgauge.functions import text as tx

TIME_FACTORIES = {f"{unit.capitalize()}1": unit for unit in dims.UNITS}
# First and last second operand.
OPERAND_RANGES = {"mult": (0, 99), "plus": (0, 99), "compare": (1, 100), "concat": (1, 50)}


def _rows(terms: DataFrame, factory: str | Column, key, x, y, z, word=None, operator=None) -> DataFrame:
    if word is None:
        operator, word = (F.lit(v) for v in dims.FACTORIES[factory])
    return terms.select(
        (factory if isinstance(factory, Column) else F.lit(factory)).alias("factory_type"),
        key.cast("string").alias("key"),
        F.col("frequency").cast("bigint").alias("frequency"),
        x.cast("string").alias("x"),
        y.cast("string").alias("y"),
        z.cast("string").alias("z"),
        word.alias("word"),
        operator.alias("math_operator"),
    )


def _with_operands(terms: DataFrame, kind: str) -> DataFrame:
    first, last = OPERAND_RANGES[kind]
    operands = F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint")))
    return terms.select("*", tx.to_int(F.col("n1")).alias("a"), operands.alias("b"))


def _tuple_text(*parts: Column) -> Column:
    """The parts as ``('12', '7')``."""
    quoted = [F.concat(F.lit("'"), p, F.lit("'")) for p in parts]
    return F.concat(F.lit("("), F.concat_ws(", ", *quoted), F.lit(")"))


def num1_mult(terms: DataFrame, factory: str = "Num1Mult") -> DataFrame:
    rows = _with_operands(terms, "mult")
    return _rows(rows, factory, F.col("n1"), F.col("a"), F.col("b"), F.col("a") * F.col("b"))


def num1_plus(terms: DataFrame, factory: str = "Num1Plus") -> DataFrame:
    rows = _with_operands(terms, "plus")
    return _rows(rows, factory, F.col("n1"), F.col("a"), F.col("b"), F.col("a") + F.col("b"))


def num1_compare(terms: DataFrame, factory: str = "Num1Less") -> DataFrame:
    rows = _with_operands(terms, "compare").where("a <> b")
    z = F.least("a", "b") if factory == "Num1Less" else F.greatest("a", "b")
    return _rows(rows, factory, F.col("n1"), F.col("a"), F.col("b"), z)


def num1_concat(terms: DataFrame, factory: str = "Num1concat#") -> DataFrame:
    rows = _with_operands(terms, "concat")
    z = F.concat("n1", F.col("b").cast("string"))
    return _rows(rows, factory, F.col("n1"), F.col("n1"), F.col("b"), z)


def num1_mod10(terms: DataFrame, factory: str = "Num1mode10#") -> DataFrame:
    return _rows(terms, factory, F.col("n1"), F.col("n1"), F.lit("10"), F.right("n1", F.lit(1)))


def _num2(terms: DataFrame, factory: str, z: Column) -> DataFrame:
    return _rows(terms, factory, _tuple_text(F.col("n1"), F.col("n2")), F.col("n1"), F.col("n2"), z)


def num2_plus(terms: DataFrame, factory: str = "Num2Plus") -> DataFrame:
    return _num2(terms, factory, tx.to_int(F.col("n1")) + tx.to_int(F.col("n2")))


def num2_mult(terms: DataFrame, factory: str = "Num2Mult") -> DataFrame:
    return _num2(terms, factory, tx.to_int(F.col("n1")) * tx.to_int(F.col("n2")))


def unit_dim_join(terms: DataFrame) -> DataFrame:
    """Rows of ``terms`` whose ``keyword`` is a convertible unit, with the unit's multiplier,
    source and target names. The dimension has seven rows."""
    units = F.broadcast(dims.unit_dimension(terms.sparkSession))
    return terms.join(units, F.col("keyword") == F.col("unit")).drop("unit")


def time_unit(terms: DataFrame, factory: str | None = None) -> DataFrame:
    """``factory`` is Minute1 to Decade1, terms of other units are left out; by default all
    units at once."""
    if factory is not None:
        terms = terms.where(F.col("keyword") == TIME_FACTORIES[factory])
    key = _tuple_text(F.col("n1"), F.col("keyword"))
    z = tx.to_int(F.col("n1")) * F.col("multiplier")
    own_factory = F.concat(F.initcap("keyword"), F.lit("1"))
    return _rows(
        unit_dim_join(terms), own_factory, key, F.col("n1"), F.col("multiplier"), z, F.col("keyword"), F.lit("*")
    )


_EXPANDERS = {
    "Num1Mult": num1_mult,
    "Num1#*": num1_mult,
    "Num2Mult": num2_mult,
    "Num2#*": num2_mult,
    "Num1Plus": num1_plus,
    "Num1#+": num1_plus,
    "Num2Plus": num2_plus,
    "Num2#+": num2_plus,
    "Num1concat#": num1_concat,
    "Num1mode10#": num1_mod10,
    "Num1Less": num1_compare,
    "Num1More": num1_compare,
    **{factory: time_unit for factory in TIME_FACTORIES},
}


def operand_expand(terms: DataFrame, factory: str) -> DataFrame:
    """Operand rows for the terms: ``n1, frequency`` for Num1 factories, ``n1, n2, frequency``
    for Num2 and ``n1, keyword, frequency`` for time units."""
    if factory == "Num1MoreLess":
        return more_less(terms)
    if factory not in _EXPANDERS:
        raise ValueError(f"unknown factory type {factory!r}; known: {', '.join(_EXPANDERS)}")
    return _EXPANDERS[factory](terms, factory)


def more_less(terms: DataFrame) -> DataFrame:
    """Both comparison groups, told apart by ``factory_type``."""
    return num1_compare(terms, "Num1More").unionByName(num1_compare(terms, "Num1Less"))


def template_dim_join(rows: DataFrame) -> DataFrame:
    """Operator and question word by ``factory_type``, from a dimension of 13 rows."""
    templates = F.broadcast(dims.factory_dimension(rows.sparkSession))
    return rows.drop("word", "math_operator").join(templates, "factory_type")


def digit_limit_filter(rows: DataFrame, digit_limit: int = 2) -> DataFrame:
    return rows.where((F.length("x") <= digit_limit) & (F.length("y") <= digit_limit))


def question_arithmetic(x: Column, word: Column, y: Column) -> Column:
    return F.format_string("What is %s %s %s?", x, word, y)


def question_comparison(x: Column, word: Column, y: Column) -> Column:
    return F.format_string("Which one is %s? %s or %s", word, x, y)


def question_time_unit(x: Column, unit: Column) -> Column:
    target = dims.lookup(unit, {u: t for u, (_, t) in dims.UNITS.items()})
    return F.format_string("What is %s %ss in %s?", x, unit, target)


def _question(factory: Column) -> Column:
    """Text by the kind of ``factory``; the question word is the factory's own."""
    x, y = F.col("x"), F.col("y")
    word = dims.lookup(factory, {f: w for f, (_, w) in dims.FACTORIES.items()})
    lower = F.lower(factory)
    compares = lower.contains("less") | lower.contains("more")
    return (
        F.when(factory.startswith("Num") & compares, question_comparison(x, word, y))
        .when(factory.startswith("Num"), question_arithmetic(x, word, y))
        .otherwise(question_time_unit(x, dims.lookup(factory, TIME_FACTORIES)))
    )


def datapoints(rows: DataFrame, filters=(digit_limit_filter,), templates=()) -> DataFrame:
    """Operand rows that pass every filter, with ``question`` and ``answer``.

    Filters map a DataFrame to a DataFrame. ``templates`` names factory types whose question
    forms are all applied to each row; by default a row gets the form of its own factory.
    """
    for keep in filters:
        rows = keep(rows)
    if templates:
        forms = F.explode(F.array(*[_question(F.lit(t)) for t in templates]))
    else:
        forms = _question(F.col("factory_type"))
    return rows.select("*", forms.alias("question"), F.col("z").alias("answer"))


def question_numbers(question: Column) -> Column:
    """Numbers among the blank-separated parts of a question without its last character.

    A comparison question ends in its second number, which thereby loses its last digit.
    """
    parts = tx.tokenize(F.left(question, F.greatest(F.length(question) - 1, F.lit(0))))
    numbers = F.filter(parts, tx.is_decimal)
    return F.transform(numbers, tx.to_int)
