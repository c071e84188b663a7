from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termgauge.operators import counting, windows
from tests import brute

TOKENS = st.sampled_from("1 2 05 5 10 123456 1234567 x the, 3.5 ٣ minute Minutes days plus + * -".split())
TEXTS = st.lists(st.lists(TOKENS, max_size=25).map(" ".join), min_size=20, max_size=40)
SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def as_counter(counts):
    return Counter({tuple(r)[:-1]: r.frequency for r in counts.collect()})


@SLOW
@given(texts=TEXTS)
def test_counts_match_brute_force(corpus_of, texts):
    corpus = corpus_of(*texts)
    cut = windows.number_windows(corpus)
    for k in (1, 2, 3):
        expected = brute.number_tuples(texts, k)
        assert as_counter(counting.num_co_occurrence(corpus, k)) == expected
        assert as_counter(counting.num_co_occurrence_in_windows(cut, k)) == expected
    for k in (1, 2):
        expected = brute.keyword_tuples(texts, k)
        assert as_counter(counting.word_num_occurrence(corpus, k)) == expected
        assert as_counter(counting.word_num_occurrence_in_windows(cut, k)) == expected
        assert as_counter(counting.word_num_occurrence_original(corpus, k)) == expected
    assert as_counter(counting.arithmetic_pattern(corpus)) == brute.arithmetic(texts)
    assert as_counter(counting.arithmetic_pattern_in_windows(cut)) == brute.arithmetic(texts)


@pytest.mark.parametrize("w", [1, 2, 3, 8])
def test_other_window_sizes(corpus_of, w):
    texts = ["1 2 + 3 4 5 days 6 x 7 8 9", "5 minutes 5 5 5 plus 1 1"] * 3
    corpus = corpus_of(*texts)
    assert as_counter(counting.num_co_occurrence(corpus, 2, w)) == brute.number_tuples(texts, 2, w)
    assert as_counter(counting.word_num_occurrence(corpus, 3, w)) == brute.keyword_tuples(texts, 3, w)
    assert as_counter(counting.word_num_occurrence_original(corpus, 3, w)) == brute.keyword_tuples(texts, 3, w)
    expected = brute.arithmetic(texts) if w >= 5 else Counter()
    assert as_counter(counting.arithmetic_pattern(corpus, w)) == expected


def test_worked_examples(corpus_of, rows_of):
    from_first = counting.number_anchors(corpus_of("1 2 + 3 4 5")).where("token = '1'")
    keys = counting.word_number_keys(from_first, 2, window_size=4)
    assert rows_of(keys) == [("1", "2", "+"), ("1", "3", "+")]
    assert rows_of(counting.co_occurrence_keys(from_first, 2, 4)) == [("1", "2"), ("1", "3")]
    assert rows_of(counting.num_co_occurrence(corpus_of("9 x 10"))) == [("10", "9", 1)]
    assert rows_of(counting.arithmetic_pattern(corpus_of("2 times 3 is 6", "2 times 3 is"))) == [("2", "3", "6", 1)]
    assert rows_of(counting.num_occurrence(corpus_of("05 5"))) == [("05", 1), ("5", 1)]


def test_long_text_and_hot_text(corpus_of):
    """A text of 20,000 words, and one text that makes up most of the corpus."""
    long = " ".join(str(i % 7) if i % 3 else "day" for i in range(20_000))
    texts = [long] + ["1 plus 2"] * 300
    corpus = corpus_of(*texts)
    tokens = long.split()
    pairs = Counter()
    for i, a in enumerate(tokens):
        for b in tokens[i + 1 : i + 5]:
            if a != "day" and b != "day":
                pairs[tuple(sorted((a, b)))] += 1
    pairs[("1", "2")] += 300
    assert as_counter(counting.num_co_occurrence(corpus, 2)) == pairs


def test_merging_shards_equals_one_pass(corpus_of, rows_of):
    texts = ["1 2 3 days", "3 2 1", "9 9 9 plus 9"]
    shards = [counting.word_num_occurrence(corpus_of(t)) for t in texts]
    assert rows_of(counting.merge_counts(*shards)) == rows_of(counting.word_num_occurrence(corpus_of(*texts)))
    assert rows_of(counting.distinct_keywords(counting.merge_counts(*shards))) == [("day",), ("plus",)]


def test_sorting_and_top(spark):
    rows = [("a", "day", 3), ("b", "day", 5), ("c", "day", 3), ("a", "+", 1), ("b", "+", 9)]
    counts = spark.createDataFrame(rows, "n1 string, keyword string, frequency long")
    assert [r.frequency for r in counting.sort_by_frequency(counts).collect()] == [9, 5, 3, 3, 1]
    assert [r.n1 for r in counting.top_terms(counts.where("keyword = 'day'"), 2).collect()] == ["b", "a"]
    best = counting.top_terms_per_keyword(counts, 2)
    assert sorted((r.keyword, r.rank, r.n1) for r in best.collect()) == [
        ("+", 1, "b"), ("+", 2, "a"), ("day", 1, "b"), ("day", 2, "a"),
    ]


def test_counting_plan_has_one_shuffle_and_reads_text_only(spark, tmp_path, corpus_of):
    corpus_of("1 2 3").write.parquet(str(tmp_path / "c.parquet"))
    corpus = spark.read.parquet(str(tmp_path / "c.parquet"))
    for counts in (counting.num_co_occurrence(corpus, 3), counting.word_num_occurrence(corpus, 2)):
        plan = counts._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert "ReadSchema: struct<text:string>" in plan
        assert "Python" not in plan


def test_generated_code_is_small_enough_to_be_compiled_natively(spark, corpus_of):
    explain = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for counts in (
            counting.num_co_occurrence(corpus_of("1 day"), 3),
            counting.word_num_occurrence(corpus_of("1 day"), 2),
            counting.word_num_occurrence_original(corpus_of("1 day"), 2),
        ):
            text = counts._jdf.queryExecution().explainString(explain)
            sizes = [int(s.split(";")[0]) for s in text.split("maxMethodCodeSize:")[1:]]
            # The JVM interprets methods of more than 8000 bytes.
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_keywords_that_are_numbers(corpus_of, rows_of):
    from termgauge.functions import text as tx

    found = counting.word_num_occurrence(corpus_of("7 x"), 1, keywords=tx.Keywords([(r"\d+", False)]))
    assert rows_of(found) == [("7", "7", 1)]


def test_count_by_key(spark, rows_of):
    keys = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, v int")
    assert rows_of(counting.count_by_key(keys).orderBy(F.col("k"))) == [("a", 1, 2), ("b", 1, 1)]
