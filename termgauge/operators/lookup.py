"""Joining graded answers to term frequencies, and the row filters around it.

Graded answers have ``word, x, y, z, is_correct`` with integer operands, and any columns that
name the experiment. Frequency tables have ``n1..nk, keyword, frequency``; the keyword is empty
for plain number counts, so that one join serves all experiment words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgauge.functions import dimensions as dims
from termgauge.functions import text as tx
from termgauge.operators.skew import asked_lookup, asked_part, left_lookup
from termgauge.session import materialise

# Operands that form the frequency key, by key type.
KEY_TYPES = {
    "x": ("x",),
    "xy": ("x", "y"),
    "xz": ("x", "z"),
    "yz": ("y", "z"),
    "xyz": ("x", "y", "z"),
}


def number_columns(key_type: str) -> list[str]:
    if key_type not in KEY_TYPES:
        raise ValueError(f"unknown key type {key_type!r}; known: {', '.join(KEY_TYPES)}")
    return [f"n{i + 1}" for i in range(len(KEY_TYPES[key_type]))]


def frequency_table(numbers: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Number counts and, if given, number-keyword counts in one table."""
    plain = numbers.withColumn("keyword", F.lit(""))
    return plain if words is None else plain.unionByName(words)


def in_order(operands: Sequence[Column]) -> list[Column]:
    """One to three values, smallest first, without a comparator that is called row by row."""
    if len(operands) == 1:
        return list(operands)
    low, high = F.least(*operands), F.greatest(*operands)
    if len(operands) == 2:
        return [low, high]
    a, b, c = operands
    return [low, F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)), high]


def keyword_of(word: Column) -> Column:
    """The unit word of an experiment, empty for experiments without one; other words are an error."""
    unknown = F.concat(F.lit("unknown experiment word: "), F.coalesce(word, F.lit("NULL")))
    known = F.when(word.isin(list(dims.NO_WORD_KEYS)), F.lit("")).when(word.isin(list(dims.UNITS)), word)
    return known.otherwise(F.raise_error(unknown).cast("string"))


def with_key(graded: DataFrame, key_type: str) -> DataFrame:
    """Adds the key columns ``n1..nk`` (operands as strings, in string order) and ``keyword``
    (the unit word, empty for experiments without one)."""
    names = number_columns(key_type)
    operands = in_order([F.col(c).cast("string") for c in KEY_TYPES[key_type]])
    return graded.select(
        "*", *[o.alias(name) for o, name in zip(operands, names)], keyword_of(F.col("word")).alias("keyword")
    )


def key_text(names: Sequence[str]) -> Column:
    """The key as printed: ``23``, ``('24', '47')`` or ``('5', 'minute')``."""
    parts = [F.concat(F.lit("'"), F.col(n), F.lit("'")) for n in names]
    word = F.when(F.col("keyword") != "", F.concat(F.lit("'"), F.col("keyword"), F.lit("'")))
    listed = F.concat(F.lit("("), F.concat_ws(", ", *parts, word), F.lit(")"))
    return listed if len(names) > 1 else F.when(F.col("keyword") == "", F.col(names[0])).otherwise(listed)


def key_parts(key: Column, is_timeunit: Column | bool = False) -> Column:
    """Numbers of a printed key as ARRAY<BIGINT>, without the unit word."""
    quoted = F.regexp_extract_all(key, F.lit("'([^']*)'"), F.lit(1))
    is_timeunit = F.lit(is_timeunit) if isinstance(is_timeunit, bool) else is_timeunit
    numbers = F.when(is_timeunit, F.slice(quoted, 1, F.greatest(F.size(quoted) - 1, F.lit(0)))).otherwise(quoted)
    return F.transform(F.when(F.size(quoted) == 0, F.array(key)).otherwise(numbers), tx.to_int)


# ---------------------------------------------------------------- joins


def lookup_frequency(graded: DataFrame, frequencies: DataFrame, key_type: str) -> DataFrame:
    """Every graded answer with the corpus frequency of its key: adds ``lookup_key``,
    ``lookup_frequency`` (0 if the key was never counted) and ``found``."""
    names = number_columns(key_type)
    keys = [*names, "keyword"]
    table = frequencies.withColumnRenamed("frequency", "lookup_frequency")
    rows = asked_lookup(with_key(graded, key_type), table, keys)
    return rows.select(
        *graded.columns,
        key_text(names).alias("lookup_key"),
        F.coalesce("lookup_frequency", F.lit(0)).alias("lookup_frequency"),
        F.col("lookup_frequency").isNotNull().cast("int").alias("found"),
    )


def lookup_pair_frequency(graded: DataFrame, pair_counts: DataFrame) -> DataFrame:
    """Every graded answer with the frequency of the pair (x, z), stored in either order.

    If both orders are stored the sorted one counts. Adds ``pair_key``, ``pair_frequency`` and
    ``found`` as above. The distinct pairs of the answers look both orders up in the count table,
    which is not regrouped; the answers then look up their pair.
    """
    x, z = F.col("x").cast("string"), F.col("z").cast("string")
    rows = graded.select("*", F.least(x, z).alias("a"), F.greatest(x, z).alias("b"))
    asked = rows.select("a", "b").distinct()
    orders = [F.struct("a", "b", F.lit(True).alias("sorted")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(False).alias("sorted"))]
    tried = asked.select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.explode(F.array(*orders)).alias("o"))
    tried = tried.where("o.sorted OR a0 <> b0").select("a0", "b0", "o.sorted", F.col("o.a").alias("n1"), F.col("o.b").alias("n2"))
    stored = tried.join(pair_counts.select("n1", "n2", "frequency"), ["n1", "n2"])
    found = stored.groupBy(F.col("a0").alias("a"), F.col("b0").alias("b")).agg(
        F.max_by(F.struct("n1", "n2", "frequency"), F.col("sorted")).alias("pair")
    )
    rows = left_lookup(rows, found, ["a", "b"])
    key = F.concat(
        F.lit("('"), F.coalesce("pair.n1", "a"), F.lit("', '"), F.coalesce("pair.n2", "b"), F.lit("')")
    )
    return rows.select(
        *graded.columns,
        key.alias("pair_key"),
        F.coalesce("pair.frequency", F.lit(0)).alias("pair_frequency"),
        F.col("pair").isNotNull().cast("int").alias("found"),
    )


def pair_order_check(pair_counts: DataFrame) -> DataFrame:
    """Pairs stored in both orders: ``a < b`` with the frequency of either order."""
    pairs = pair_counts.where("n1 <> n2").groupBy(
        F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")
    )
    sorted_order = F.col("n1") < F.col("n2")
    return pairs.agg(
        F.max(F.when(sorted_order, F.col("frequency"))).alias("frequency_ab"),
        F.max(F.when(~sorted_order, F.col("frequency"))).alias("frequency_ba"),
    ).where("frequency_ab IS NOT NULL AND frequency_ba IS NOT NULL")


def not_found_count(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Looked-up rows and misses per cell."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("looked_up"),
        F.sum(1 - F.col("found")).cast("bigint").alias("not_found"),
    )


# ---------------------------------------------------------------- filters and unions


def pair_digit_filter(pair_counts: DataFrame, digit_limit: int = 2) -> DataFrame:
    """Pairs of which either number has at most ``digit_limit`` digits."""
    return pair_counts.where((F.length("n1") <= digit_limit) | (F.length("n2") <= digit_limit))


def small_operand_filter(graded: DataFrame, smallest: int = 11) -> DataFrame:
    """Answers whose operands and result are all at least ``smallest``."""
    return graded.where((F.col("x") >= smallest) & (F.col("y") >= smallest) & (F.col("z") >= smallest))


def jitter(*columns: str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(2**53))


def drop_zero_frequency(
    rows: DataFrame, column: str, keys: Sequence[str], drop: bool = True, seed: int = 0
) -> DataFrame:
    """Replace zero frequencies by a jitter in (0, 1); with ``drop``, leave such rows out."""
    if drop:
        return rows.where(F.col(column) >= 1)
    value = F.when(F.col(column) > 0, F.col(column).cast("double")).otherwise(jitter(*keys, seed=seed))
    return rows.withColumn(column, value)


def is_round_key(parts: Column) -> Column:
    """Whether any number of a key has one digit or ends in zero."""
    return F.exists(parts, lambda i: (F.length(i.cast("string")) < 2) | (i % 10 == 0))


def round_key_filter(rows: DataFrame, parts: str = "parts") -> DataFrame:
    return rows.where(~is_round_key(F.col(parts)))


def symmetry_union(graded: DataFrame) -> DataFrame:
    """All answers, and those with x <> y once more with x and y swapped."""
    swapped = graded.where("x <> y").withColumns({"x": F.col("y"), "y": F.col("x")})
    return graded.unionByName(swapped)


def symmetry_check(graded: DataFrame, values: Sequence[int]) -> DataFrame:
    """Answers with x = k and with y = k before and after ``symmetry_union``."""

    def sides(rows: DataFrame, name: str) -> DataFrame:
        both = F.array(
            F.struct(F.col("x").alias("k"), F.lit(f"x_{name}").alias("side")),
            F.struct(F.col("y").alias("k"), F.lit(f"y_{name}").alias("side")),
        )
        return rows.select(F.inline(both)).where(F.col("k").isin(list(values)))

    rows = sides(graded, "before").unionByName(sides(symmetry_union(graded), "after"))
    count = lambda side: F.count_if(F.col("side") == side).alias(side)
    return rows.groupBy("k").agg(*[count(s) for s in ("x_before", "y_before", "x_after", "y_after")])


# ---------------------------------------------------------------- accuracy per frequency key


def operand_sums(graded: DataFrame, by: Sequence[str] = ("word", "model", "shots")) -> DataFrame:
    """Answers summed per cell and operands, for ``key_accuracy`` of several key types: ``by, x, y, z, answers, correct``."""
    return graded.groupBy(*by, "x", "y", "z").agg(
        F.count(F.lit(1)).alias("answers"), F.sum("is_correct").cast("bigint").alias("correct")
    )


def key_accuracy(
    graded: DataFrame,
    frequencies: Callable[[int], DataFrame],
    key_type: str,
    by: Sequence[str] = ("word", "model", "shots"),
    use_filter: bool = False,
    drop_zero: bool = True,
    make_symmetry: bool = False,
    seed: int = 0,
) -> DataFrame:
    """One row per experiment cell and frequency key: ``by, key_type, key, parts, frequency,
    answers, correct, accuracy, mean_x``.

    Answers are summed per key before the join, so both sides of it hold a key once per cell
    and no key is heavy. ``frequencies`` maps a number of key parts to its frequency table.
    ``by`` must include ``word``. ``graded`` may be ``operand_sums`` of the same cells.
    """
    known = {"answers", "correct"} <= set(graded.columns)
    answers, correct = (F.col("answers"), F.col("correct")) if known else (F.lit(1), F.col("is_correct"))
    names = number_columns(key_type)
    keys = [*names, "keyword"]
    rows = symmetry_union(graded) if make_symmetry else graded
    rows = small_operand_filter(rows) if use_filter else rows
    summed = (
        with_key(rows, key_type)
        .groupBy(*by, *keys)
        .agg(
            F.sum(answers).alias("answers"),
            F.sum(correct).cast("bigint").alias("correct"),
            F.try_divide(F.sum(F.col("x").cast("double") * answers), F.sum(F.when(F.col("x").isNotNull(), answers))).alias("mean_x"),
        )
    )
    summed = materialise(summed, "key-answers")
    joined = summed.join(asked_part(summed, frequencies(len(names)), keys), keys, "left").withColumn(
        "frequency", F.coalesce("frequency", F.lit(0))
    )
    kept = drop_zero_frequency(joined, "frequency", [*by, *keys], drop_zero, seed)
    return kept.select(
        *by,
        F.lit(key_type).alias("key_type"),
        key_text(names).alias("key"),
        F.transform(F.array(*names), tx.to_int).alias("parts"),
        F.col("frequency").cast("double").alias("frequency"),
        "answers",
        "correct",
        (F.col("correct") / F.col("answers")).alias("accuracy"),
        "mean_x",
    )


def mean_by_frequency_key(rows: DataFrame, key: str, frequency: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean accuracy, frequency and x per key of rows that carry them, for any key column."""
    return rows.groupBy(*by, key).agg(
        F.avg("x").alias("mean_x"),
        F.avg("is_correct").alias("accuracy"),
        F.avg(frequency).alias("mean_frequency"),
    )


def overall_accuracy(keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy over all kept answers of a cell."""
    return keys.groupBy(*by).agg(
        F.sum("answers").alias("answers"),
        (F.sum("correct") / F.sum("answers")).alias("accuracy"),
    )


def important_points(keys: DataFrame, values: Sequence[int]) -> DataFrame:
    """Keys whose mean x is one of ``values``, with a printable ``label``."""
    label = F.array_join(F.transform("parts", lambda p: p.cast("string")), " ")
    return keys.where(F.col("mean_x").cast("int").isin(list(values))).withColumn("label", label)
