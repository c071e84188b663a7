import random

import pytest
from pyspark.sql import functions as F

from termgauge.functions import text as tx
from termgauge.operators import counting, windows
from tests import brute


def values(spark, strings, column):
    rows = [(i, s) for i, s in enumerate(strings)]
    df = spark.createDataFrame(rows, "i int, s string").select("i", column.alias("v"))
    return [r.v for r in df.orderBy("i").collect()]


def test_tokenize_splits_like_python_on_every_character(spark):
    texts = [f"a{chr(c)}b" for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts += ["", "   ", "　x ", " a  b\tc\n", " ", "one"]
    assert values(spark, texts, tx.tokenize(F.col("s"))) == [t.split() for t in texts]


def test_is_number(spark):
    tokens = ["0", "05", "123456", "1234567", "12a", "-1", "+5", "3.2", "10:12", "٣", "𝟙𝟚", "²", "", "1\x00", ":", "/"]
    assert values(spark, tokens, tx.is_number(F.col("s"))) == [brute.is_number(t) for t in tokens]


def test_is_decimal_and_to_int(spark):
    tokens = ["1234567890", "007", "٣", "x", "12x", "𝟙𝟚"]
    assert values(spark, tokens, tx.is_decimal(F.col("s"))) == [t.isdecimal() for t in tokens]
    assert values(spark, tokens, tx.to_int(F.col("s"))) == [1234567890, 7, 3, None, None, 12]


def test_keywords(spark):
    expected = {
        "minUte": "minute", "MINUTES": "minute", "+": "+", "*": "*", "-": "-", "times": "times",
        "time": None, "timess": None, "minutess": None, "+minute": None, "s": None, "pluſ": "pluſ",
        "Decade": "decade", "hours.": None, "mınute": "mınute",
    }
    assert values(spark, list(expected), tx.DEFAULT_KEYWORDS.match(F.col("s"))) == list(expected.values())


def test_keyword_fragments_and_order(spark):
    words = tx.Keywords([("days", False), ("day", True), ("mon(?:th)?", True), (r"\d+th", False)])
    tokens = ["days", "Day", "mons", "months", "12TH", "dayss"]
    assert values(spark, tokens, words.match(F.col("s"))) == ["days", "day", "mon", "month", "12th", None]


def test_long_keyword_lists(spark, monkeypatch):
    """Looked up by hash, with the same stems as the regular expression."""
    rng = random.Random(2)
    made = {"".join(rng.choice("aiks-") for _ in range(rng.randint(1, 5))) for _ in range(400)}
    specs = [(r"\+", False), ("days", False), ("day", True), ("week", True), ("weeks", False), *[(w, rng.random() < 0.5) for w in sorted(made)]]
    tokens = ["+", "+s", "days", "DAYS", "dayss", "weeks", "Weekſ", "\u212aiss", "\u0130s", "ıK", "aıſ", "unknown", ""]
    tokens += ["".join(rng.choice("aAiIkKsS-\u0130\u0131\u212aſ") for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    listed = tx.Keywords(specs)
    assert listed.listed
    got = values(spark, tokens, listed.match(F.col("s"))), values(spark, tokens, listed.found(F.col("s")))
    monkeypatch.setattr(tx, "MOST_ALTERNATIVES", 10**6)
    regex = tx.Keywords(specs)
    assert not regex.listed
    want = values(spark, tokens, regex.match(F.col("s"))), values(spark, tokens, regex.found(F.col("s")))
    assert got == want and any(want[0])


def test_twenty_thousand_keywords(corpus_of, rows_of):
    specs = [*tx.DEFAULT_KEYWORDS.specs, *[(f"w{i}x", i % 2 == 0) for i in range(20_000)]]
    corpus = corpus_of("5 minutes and 7 W12xs or 9 w13x", "3 w13xs w99999x 4 plus")
    found = rows_of(counting.word_num_occurrence(corpus, 1, keywords=tx.Keywords(specs)), "n1", "keyword", "frequency")
    assert ("7", "w12x", 1) in found and ("9", "w13x", 1) in found and ("4", "plus", 1) in found
    assert {k for _, k, _ in found} == {"minute", "w12x", "w13x", "plus"}


@pytest.mark.parametrize("w", [1, 2, 5, 7])
def test_text_windows(corpus_of, w):
    texts = ["1 2 3", "", "a", "x y z " * 7, " lead and trail  "]
    found = windows.text_windows(corpus_of(*texts), w).orderBy("doc_id", "pos").collect()
    assert [r.window for r in found] == [x for t in texts for x in brute.windows(t, w)]
    assert [r.middle for r in found] == [x for t in texts for x in t.split()]


def test_number_windows(corpus_of, rows_of):
    found = windows.number_windows(corpus_of("1 2 3"), 5)
    none = "NONEWORD "
    assert rows_of(found, "middle", "text") == [
        ("1", none * 4 + "1 2 3" + " NONEWORD" * 2),
        ("2", none * 3 + "1 2 3" + " NONEWORD" * 3),
        ("3", none * 2 + "1 2 3" + " NONEWORD" * 4),
    ]
    assert found.columns == ["meta", "text", "middle"]


def test_keyword_windows(corpus_of, rows_of):
    found = windows.keyword_windows(corpus_of("1 second + a 4 MINUTES"), 2)
    assert rows_of(found, "match", F.array_join("window", " ")) == [
        ("+", "second + a"),
        ("minute", "4 MINUTES NONEWORD"),
        ("second", "1 second +"),
    ]


# Texts with the spans, keywords and pattern forms found in them.
PATTERNS = [
    ("987 MinuTes 78 927 9876", [("987 MinuTes 78 927 ", "MinuTe", 1)]),
    ("987 hourS 78 927 9876", [("987 hourS 78 927 ", "hour", 1)]),
    ("987 days 78 927 9876", [("987 days 78 927 ", "day", 1)]),
    ("987 days 654 months 78 927 9876", [(" 654 months 78 927 ", "month", 1), ("987 days 654 ", "day", 2)]),
    (
        "987  days  654  decades 43  months   234     765",
        [(" 43  months   234     765", "month", 1), (" 654  decades 43 ", "decade", 2), ("987  days  654 ", "day", 2)],
    ),
    ("  2 months 4.5  months 3.4.5", []),
    ("  2.5 months 1 3", []),
    ("2. 5 months 1 3", [(" 5 months 1 3", "month", 1)]),
    ("2. 05 moNThs 1 3", [(" 05 moNThs 1 3", "moNTh", 1)]),
    (
        "1 months 2 3\n1 months 2 3\n1 months 2 3\n1 months 2 3",
        [("\n1 months 2 3", "month", 1), ("\n1 months 2 3\n", "month", 1), ("\n1 months 2 3\n", "month", 1), ("1 months 2 3\n", "month", 1)],
    ),
    ("1 months !!! 3 ", [("1 months !!! 3 ", "month", 3)]),
]


@pytest.mark.parametrize("text,expected", PATTERNS)
def test_number_keyword_patterns(corpus_of, rows_of, text, expected):
    found = windows.number_keyword_patterns(corpus_of(text))
    assert rows_of(found, "span", "keyword", "alternative") == expected
