"""Few-shot prompts: sampling shots, dropping leaking questions, writing the prompt.

Samples are ordered by the MD5 of seed and question, so any engine draws the same ones. Shots
are at most ``shots`` rows per seed and factory, which bounds everything broadcast here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgauge.functions import text as tx
from termgauge.operators.questions import question_numbers
from termgauge.session import materialise

ROW_ID = ("seed", "factory_type", "question", "key")


def multi_seed(rows: DataFrame, seeds: int = 5) -> DataFrame:
    """Every row once per seed 0..seeds-1."""
    return rows.select(F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"), "*")


def _draw_order() -> Column:
    return F.md5(F.concat(F.col("seed").cast("string"), F.lit(":"), F.col("question")))


def _quota(groups: list[str], shots: int) -> Column:
    """Shots per factory: equal parts, the remainder to the first factories."""
    base, rest = divmod(shots, len(groups))
    quota = F.lit(base)
    for group in groups[:rest]:
        quota = F.when(F.col("factory_type") == group, base + 1).otherwise(quota)
    return quota


def _split(points: DataFrame, quota: Column, at_most: int) -> tuple[DataFrame, DataFrame]:
    ordered = points.withColumn("draw", _draw_order())
    rank = F.row_number().over(Window.partitionBy("seed", "factory_type").orderBy("draw", "key"))
    # The constant bound lets each input partition drop all but the first rows of a group
    # before the shuffle, so no task sorts a whole group.
    first = ordered.withColumn("place", rank).where(F.col("place") <= at_most)
    train = first.where(F.col("place") <= quota).drop("place")
    # Shots grow with seeds and factories: whether they are broadcast is left to their measured size.
    test = ordered.join(train.select(*ROW_ID), list(ROW_ID), "left_anti")
    return train, test.select(*train.columns)


def split_shots(points: DataFrame, shots: int) -> tuple[DataFrame, DataFrame]:
    """``(train, test)``: per seed and factory the first ``shots`` rows in draw order, and the
    rest. Both carry ``draw``, the draw order."""
    return _split(points, F.lit(shots), shots)


def split_shots_grouped(points: DataFrame, shots: int, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """Like ``split_shots``, with ``shots`` divided over the factories in ``groups``."""
    return _split(points, _quota(groups, shots), -(-shots // len(groups)))


def _number_set(faithful: bool) -> Column:
    if faithful:
        numbers = question_numbers(F.col("question"))
    else:
        numbers = F.array(tx.to_int(F.col("x")), tx.to_int(F.col("y")))
    return F.array_sort(F.array_distinct(numbers))


def leakage_filter(test: DataFrame, train: DataFrame, faithful: bool = True) -> DataFrame:
    """Test rows whose set of numbers equals that of no shot of the same seed.

    ``faithful`` reads the numbers from the question text, see ``question_numbers``; otherwise
    they are the operands.
    """
    shots = train.select("seed", _number_set(faithful).alias("numbers")).distinct()
    rows = test.withColumn("numbers", _number_set(faithful))
    return rows.join(shots, ["seed", "numbers"], "left_anti").select(*test.columns)


def render_prompt(
    test: DataFrame,
    train: DataFrame,
    question_prefix: str = "Q:",
    answer_prefix: str = "A:",
    title: str | None = None,
) -> DataFrame:
    """Test rows with the prompt in ``body``: optional title, the seed's shots in draw order,
    then the question."""
    shot = F.concat(
        F.lit(f"{question_prefix} "), "question", F.lit(f"\n{answer_prefix} "), "answer", F.lit("\n\n")
    )
    listed = F.array_sort(F.collect_list(F.struct("draw", "factory_type", "key", shot.alias("shot"))))
    shots = train.groupBy("seed").agg(F.array_join(F.transform(listed, lambda s: s.shot), "").alias("shots"))
    body = F.concat(
        F.lit(f"{title}\n\n" if title else ""),
        F.coalesce("shots", F.lit("")),
        F.lit(f"{question_prefix} "),
        "question",
        F.lit(f"\n{answer_prefix}"),
    )
    # One row for each seed, without which all prompts of a seed would meet in one task.
    return test.join(F.broadcast(shots), "seed", "left").withColumn("body", body).drop("shots")


def testcases(
    points: DataFrame,
    shots: int,
    seeds: int = 5,
    groups: list[str] | None = None,
    faithful: bool = True,
    title: str | None = None,
) -> DataFrame:
    """The whole experiment for all seeds: split, leakage filter, prompt.

    The question table and the shots are written first, since several steps read them.
    """
    seeded = multi_seed(materialise(points, "points"), seeds)
    train, test = split_shots_grouped(seeded, shots, groups) if groups else split_shots(seeded, shots)
    train = materialise(train, "shots")
    return render_prompt(leakage_filter(test, train, faithful), train, title=title)
