"""Token windows: fixed-width cut-outs of a text around a token.

A corpus has a column ``text`` and any others, such as ``doc_id`` and ``meta``. Its token array is built once per row and
every token position reads its neighbours from it by index, so no operator here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgauge.functions import text as tx


def token_positions(corpus: DataFrame, *keep: str) -> DataFrame:
    """One row per token: the kept columns, ``tokens`` (of the whole text), ``pos``, ``token``."""
    rows = corpus.select(*keep, tx.tokenize(F.col("text")).alias("tokens"))
    return rows.select("*", F.posexplode_outer("tokens").alias("pos", "token")).where("token IS NOT NULL")


def _other_columns(corpus: DataFrame) -> list[str]:
    return [c for c in corpus.columns if c != "text"]


def _window(window_size: int) -> Column:
    """2w-1 tokens around ``pos``, padded beyond both ends of the text."""
    pad = F.array_repeat(F.lit(tx.PADDING), window_size - 1)
    start = F.greatest(F.col("pos") - (window_size - 1), F.lit(0))
    before = F.slice(pad, F.lit(1), F.greatest(F.lit(window_size - 1) - F.col("pos"), F.lit(0)))
    real = F.slice("tokens", start + 1, F.col("pos") - start + window_size)
    return F.slice(F.concat(before, real, pad), 1, 2 * window_size - 1)


def text_windows(corpus: DataFrame, window_size: int = 5) -> DataFrame:
    """The window of every token: the corpus columns but ``text``, ``pos, middle, window``."""
    keep = _other_columns(corpus)
    return token_positions(corpus, *keep).select(
        *keep, "pos", F.col("token").alias("middle"), _window(window_size).alias("window")
    )


def surrounding_search(
    corpus: DataFrame, window_size: int, match: Callable[[Column], Column]
) -> DataFrame:
    """Windows whose centre token matches: the corpus columns but ``text``, ``pos, match, window``.

    ``match`` maps a token column to the matched text, NULL where there is no match.
    """
    keep = _other_columns(corpus)
    found = token_positions(corpus, *keep).withColumn("match", F.lower(match(F.col("token"))))
    return found.where("match IS NOT NULL").select(
        *keep, "pos", "match", _window(window_size).alias("window")
    )


def number_windows(corpus: DataFrame, window_size: int = 5, digit_limit: int = 6) -> DataFrame:
    """One record per number in the corpus: ``meta, text`` (the window), ``middle``."""
    found = surrounding_search(
        corpus, window_size, lambda token: F.when(tx.is_number(token, digit_limit), token)
    )
    return found.select("meta", F.array_join("window", " ").alias("text"), F.col("match").alias("middle"))


def keyword_windows(
    corpus: DataFrame, window_size: int = 5, keywords: tx.Keywords = tx.DEFAULT_KEYWORDS
) -> DataFrame:
    """Windows around keywords, with the keyword in ``match``."""
    return surrounding_search(corpus, window_size, keywords.match)


# The unit words of the number-keyword patterns.
PATTERN_KEYWORDS = ("second", "minute", "hour", "day", "week", "month", "year", "decade")


def number_keyword_patterns(
    corpus: DataFrame, keywords: tuple[str, ...] = PATTERN_KEYWORDS
) -> DataFrame:
    """Spans ``number keyword[s] number number``, ``number keyword[s] number`` and
    ``number keyword[s] token number``: the corpus columns but ``text``, ``span, keyword,
    alternative``.

    Spans may overlap. At one position the first of the three forms wins.
    """
    blank, number, other = tx.WS, r"\p{Nd}+", tx.NOT_WS + "+"
    gap, end = blank + "+", f"(?:{blank}|$)"
    word = "|".join(keywords)
    head = f"(?:^|{blank}){number}{gap}(?:{word})s?{gap}"
    forms = [
        head + number + gap + number + end,
        head + number + end,
        head + other + gap + number + end,
    ]
    spans = F.regexp_extract_all("text", F.lit(f"(?i)(?=({'|'.join(forms)}))"), F.lit(1))
    keep = _other_columns(corpus)
    rows = corpus.select(*keep, F.explode_outer(spans).alias("span")).where("span IS NOT NULL")
    return rows.select(
        *keep,
        "span",
        F.regexp_extract("span", f"(?i)({word})s?{gap}", 1).alias("keyword"),
        F.when(F.col("span").rlike(f"(?i)^{forms[0]}$"), 1)
        .when(F.col("span").rlike(f"(?i)^{forms[1]}$"), 2)
        .otherwise(3)
        .alias("alternative"),
    )
