"""Counting numbers, number tuples, number-keyword tuples and arithmetic patterns.

Each count is one scan and one shuffle: ``tuples`` counts the keys of blocks of texts, Spark adds the counts
up per key. The counts of blocks and the partial aggregation before the shuffle take up hot keys, and no
windows are written in between.

``*_keys`` give every single key as a row. They take an anchored table (``tokens``, ``pos``, ``token``), of a raw
corpus or of number windows written earlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termgauge.functions import text as tx
from termgauge.operators import tuples
from termgauge.operators.windows import token_positions
from termgauge.session import materialise


# ---------------------------------------------------------------- anchors


def number_anchors(corpus: DataFrame, digit_limit: int = 6) -> DataFrame:
    """Every number of a corpus with the tokens of its text."""
    return token_positions(corpus).where(tx.is_number(F.col("token"), digit_limit))


def window_anchors(windows: DataFrame) -> DataFrame:
    """The middle number of every window record (``text`` holds the window)."""
    # Exploding a one-element array keeps later filters from splitting the text once more.
    rows = windows.select(F.explode_outer(F.array(tx.tokenize(F.col("text")))).alias("tokens"))
    rows = rows.withColumn("pos", F.expr("CAST(size(tokens) DIV 2 AS INT)"))
    return rows.withColumn("token", F.get("tokens", F.col("pos")))


def keyword_anchors(corpus: DataFrame, keywords: tx.Keywords) -> DataFrame:
    """Every keyword of a corpus with the tokens of its text and its stem in ``keyword``."""
    found = token_positions(corpus).where(keywords.found(F.col("token")))
    return found.withColumn("keyword", keywords.stem(F.col("token"))).drop("token")


# ---------------------------------------------------------------- key generators


def _at(offset: int) -> Column:
    return F.get("tokens", F.col("pos") + offset)


def _tokens_between(rows: DataFrame, first: Column, last: Column, name: str, match: Column) -> DataFrame:
    """One row per token at positions ``first`` to ``last`` that satisfies ``match``, as
    ``<name>`` with its position ``<name>_pos``. ``match`` reads the column ``near``."""
    start = F.greatest(first, F.lit(0))
    cut = F.slice("tokens", start + 1, F.greatest(last - start + 1, F.lit(0)))
    rows = rows.select("*", F.posexplode_outer(cut).alias("i", "near"))
    rows = rows.where(F.col("near").isNotNull() & match)
    return rows.withColumn(f"{name}_pos", start + F.col("i")).withColumnRenamed("near", name).drop("i")


def _sorted_numbers(parts: Sequence[str]) -> list[Column]:
    """Columns n1..nk: the parts in string order."""
    if len(parts) == 1:
        return [F.col(parts[0]).alias("n1")]
    if len(parts) == 2:
        return [F.least(*parts).alias("n1"), F.greatest(*parts).alias("n2")]
    ordered = F.array_sort(F.array(*parts))
    return [F.get(ordered, F.lit(i)).alias(f"n{i + 1}") for i in range(len(parts))]


def _later_numbers(
    rows: DataFrame, num_count: int, last: Column, digit_limit: int, earliest: Column | None = None
) -> tuple[DataFrame, list[Column]]:
    """Extend the number ``p0`` to every choice of ``num_count`` numbers in text order."""
    for i in range(1, num_count):
        first = F.col(f"p{i - 1}_pos") + 1
        if earliest is not None:
            first = F.greatest(first, earliest)
        rows = _tokens_between(rows, first, last, f"p{i}", tx.is_number(F.col("near"), digit_limit))
    return rows, _sorted_numbers([f"p{i}" for i in range(num_count)])


def co_occurrence_keys(
    anchors: DataFrame, num_count: int, window_size: int = 5, digit_limit: int = 6
) -> DataFrame:
    """The anchor number with every choice of ``num_count - 1`` later numbers less than
    ``window_size`` tokens away: ``n1..nk`` in string order."""
    rows = anchors.withColumnsRenamed({"token": "p0", "pos": "p0_pos"})
    last = F.col("p0_pos") + (window_size - 1)
    rows, key = _later_numbers(rows, num_count, last, digit_limit)
    return rows.select(*key)


def word_number_keys(
    anchors: DataFrame,
    num_count: int,
    window_size: int = 5,
    digit_limit: int = 6,
    keywords: tx.Keywords = tx.DEFAULT_KEYWORDS,
) -> DataFrame:
    """The anchor number, a keyword on either side and ``num_count - 1`` later numbers, each
    less than ``window_size`` tokens from the anchor and from the keyword."""
    reach = window_size - 1
    rows = anchors.withColumnsRenamed({"token": "p0", "pos": "p0_pos"})
    around = (F.col("p0_pos") - reach, F.col("p0_pos") + reach)
    rows = _tokens_between(rows, *around, "keyword", keywords.found(F.col("near")))
    last = F.least("p0_pos", "keyword_pos") + reach
    rows, key = _later_numbers(rows, num_count, last, digit_limit, F.col("keyword_pos") - reach)
    return rows.select(*key, keywords.stem(F.col("keyword")).alias("keyword"))


def keyword_centred_keys(
    anchors: DataFrame, num_count: int, window_size: int = 5, digit_limit: int = 6
) -> DataFrame:
    """The same tuples from keyword anchors: ``num_count`` numbers around the keyword, all less
    than ``window_size`` tokens from the first of them."""
    reach = window_size - 1
    rows = anchors.withColumnRenamed("pos", "keyword_pos")
    around = (F.col("keyword_pos") - reach, F.col("keyword_pos") + reach)
    rows = _tokens_between(rows, *around, "p0", tx.is_number(F.col("near"), digit_limit))
    last = F.least("p0_pos", "keyword_pos") + reach
    rows, key = _later_numbers(rows, num_count, last, digit_limit)
    return rows.select(*key, "keyword")


def arithmetic_keys(anchors: DataFrame, window_size: int = 5) -> DataFrame:
    """``number token number token number`` from the anchor: ``x, y, z`` in text order.

    Windows shorter than five tokens to the right hold no such pattern.
    """
    rows = anchors.where(F.lit(window_size >= 5) & tx.is_decimal(F.col("token")))
    rows = rows.where(tx.is_decimal(_at(2)) & tx.is_decimal(_at(4)))
    return rows.select(F.col("token").alias("x"), _at(2).alias("y"), _at(4).alias("z"))


# ---------------------------------------------------------------- counts


def count_by_key(keys: DataFrame) -> DataFrame:
    """How often each key occurs, in ``frequency``."""
    return keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("frequency"))


def _numbered(num_count: int) -> list[str]:
    return [f"n{i + 1}" for i in range(num_count)]


def _number_counts(rows: DataFrame, num_count: int, window_size: int, digit_limit: int, centred: bool = False) -> DataFrame:
    keys = lambda b: tuples.number_tuples(b, num_count, window_size, centred)
    return tuples.count(rows, _numbered(num_count), keys, window_size, digit_limit)


def _word_counts(
    rows: DataFrame, num_count: int, window_size: int, digit_limit: int, keywords: tx.Keywords, centred: bool = False
) -> DataFrame:
    keys = lambda b: tuples.word_tuples(b, num_count, window_size, centred)
    return tuples.count(rows, _numbered(num_count), keys, 2 * window_size, digit_limit, keywords)


def num_occurrence(corpus: DataFrame, digit_limit: int = 6) -> DataFrame:
    return num_co_occurrence(corpus, 1, digit_limit=digit_limit)


def num_co_occurrence(
    corpus: DataFrame, num_count: int = 2, window_size: int = 5, digit_limit: int = 6
) -> DataFrame:
    """``n1..nk, frequency`` over a raw corpus."""
    return _number_counts(corpus, num_count, window_size, digit_limit)


def num_co_occurrence_in_windows(
    windows: DataFrame, num_count: int = 2, window_size: int = 5, digit_limit: int = 6
) -> DataFrame:
    """``n1..nk, frequency`` over number windows written earlier."""
    return _number_counts(windows, num_count, window_size, digit_limit, centred=True)


def word_num_occurrence(
    corpus: DataFrame,
    num_count: int = 1,
    window_size: int = 5,
    digit_limit: int = 6,
    keywords: tx.Keywords = tx.DEFAULT_KEYWORDS,
) -> DataFrame:
    """``n1..nk, keyword, frequency`` over a raw corpus, counted from the numbers."""
    return _word_counts(corpus, num_count, window_size, digit_limit, keywords)


def frequency_counts(
    corpus: DataFrame,
    num_counts: Sequence[int],
    word_counts: Sequence[int],
    label: str = "frequency-counts",
    window_size: int = 5,
    digit_limit: int = 6,
    keywords: tx.Keywords = tx.DEFAULT_KEYWORDS,
) -> tuple[dict[int, DataFrame], dict[int, DataFrame]]:
    """``num_co_occurrence`` and ``word_num_occurrence`` of several tuple sizes, by size, counted in one pass over a raw
    corpus and written once."""
    wanted = [tuples.Count(_numbered(k), lambda b, k=k: tuples.number_tuples(b, k, window_size)) for k in num_counts]
    wanted += [tuples.Count(_numbered(k), lambda b, k=k: tuples.word_tuples(b, k, window_size), True) for k in word_counts]
    counted = tuples.count_all(corpus, wanted, 2 * window_size, digit_limit, keywords if word_counts else None)
    counted = materialise(counted, label, by=["kind"])
    tables = [tuples.count_of(counted, kind, one) for kind, one in enumerate(wanted)]
    return dict(zip(num_counts, tables)), dict(zip(word_counts, tables[len(num_counts) :]))


def word_num_occurrence_in_windows(
    windows: DataFrame,
    num_count: int = 1,
    window_size: int = 5,
    digit_limit: int = 6,
    keywords: tx.Keywords = tx.DEFAULT_KEYWORDS,
) -> DataFrame:
    """``n1..nk, keyword, frequency`` over number windows written earlier."""
    return _word_counts(windows, num_count, window_size, digit_limit, keywords, centred=True)


def word_num_occurrence_original(
    corpus: DataFrame,
    num_count: int = 2,
    window_size: int = 5,
    digit_limit: int = 6,
    keywords: tx.Keywords = tx.DEFAULT_KEYWORDS,
) -> DataFrame:
    """``n1..nk, keyword, frequency`` over a raw corpus, counted from the keywords."""
    names = _numbered(num_count)
    return tuples.count(corpus, names, lambda b: tuples.keyword_tuples(b, num_count, window_size), 2 * window_size, digit_limit, keywords)


def arithmetic_pattern(corpus: DataFrame, window_size: int = 5, digit_limit: int = 6) -> DataFrame:
    """``x, y, z, frequency`` of arithmetic patterns in a raw corpus."""
    return tuples.count(corpus, ["x", "y", "z"], lambda b: tuples.patterns(b, window_size), 5, digit_limit, in_order=False)


def arithmetic_pattern_in_windows(windows: DataFrame, window_size: int = 5) -> DataFrame:
    return tuples.count(windows, ["x", "y", "z"], lambda b: tuples.patterns(b, window_size, centred=True), 5, in_order=False)


# ---------------------------------------------------------------- merge, sort, top


def key_columns(counts: DataFrame) -> list[str]:
    return [c for c in counts.columns if c != "frequency"]


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Sum the counts of any number of shards."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*key_columns(rows)).agg(F.sum("frequency").alias("frequency"))


def distinct_keywords(counts: DataFrame) -> DataFrame:
    return counts.select("keyword").distinct()


def sort_by_frequency(counts: DataFrame) -> DataFrame:
    """Most frequent first, ties in key order; the key also splits ties over the ranges."""
    return counts.orderBy(F.desc("frequency"), *key_columns(counts))


def top_terms(counts: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` most frequent keys."""
    return sort_by_frequency(counts).limit(n)


def top_terms_per_keyword(counts: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` most frequent keys of each keyword, with their ``rank``.

    The filter on the row number lets Spark drop all but ``n`` rows per keyword and input
    partition before the shuffle.
    """
    order = [F.desc("frequency"), *[c for c in key_columns(counts) if c != "keyword"]]
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy(*order))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n)
