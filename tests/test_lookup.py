import pytest
from pyspark.sql import functions as F

from termgauge.operators import lookup, skew

GRADED = "word string, model string, shots int, x long, y long, z long, is_correct int"


@pytest.fixture(scope="module")
def tables(spark):
    numbers = {
        1: [("10", 5), ("9", 7), ("05", 99)],
        2: [("10", "9", 4), ("10", "10", 2)],
        3: [("10", "9", "90", 3)],
    }
    words = {1: [("9", "minute", 6), ("9", "day", 8)], 2: [("540", "9", "minute", 1)], 3: []}

    def frequency(k):
        names = ", ".join(f"n{i + 1} string" for i in range(k))
        plain = [(*sorted(r[:-1]), r[-1]) for r in numbers[k]]
        a = spark.createDataFrame(plain, f"{names}, frequency long")
        b = spark.createDataFrame(words[k], f"{names}, keyword string, frequency long")
        return lookup.frequency_table(a, b)

    return frequency


@pytest.fixture(scope="module")
def graded(spark):
    rows = [
        ("mult", "gptj", 2, 9, 10, 90, 1),
        ("mult", "gptj", 2, 9, 10, 90, 0),
        ("mult", "gptj", 2, 10, 10, 100, 1),
        ("mult", "gptj", 2, 5, 10, 50, 1),
        ("minute", "gptj", 2, 9, 60, 540, 1),
        ("day", "gptj", 2, 9, 24, 216, 0),
        ("comparemoreless", "gptj", 2, 10, 9, 9, 0),
    ]
    return spark.createDataFrame(rows, GRADED)


def test_lookup(graded, tables, rows_of):
    got = rows_of(lookup.lookup_frequency(graded, tables(1), "x"), "lookup_key", "lookup_frequency", "found")
    assert got == sorted(
        [("9", 7, 1), ("9", 7, 1), ("10", 5, 1), ("5", 0, 0), ("('9', 'minute')", 6, 1), ("('9', 'day')", 8, 1), ("10", 5, 1)]
    )
    got = rows_of(lookup.lookup_frequency(graded, tables(2), "xy"), "lookup_key", "lookup_frequency")
    assert ("('10', '9')", 4) in got and ("('10', '10')", 2) in got and ("('60', '9', 'minute')", 0) in got
    got = rows_of(lookup.lookup_frequency(graded, tables(2), "xz"), "lookup_key", "lookup_frequency")
    assert ("('540', '9', 'minute')", 1) in got
    misses = lookup.not_found_count(lookup.lookup_frequency(graded, tables(3), "xyz"), ["word"])
    assert rows_of(misses) == [("comparemoreless", 1, 1), ("day", 1, 1), ("minute", 1, 1), ("mult", 4, 2)]
    with pytest.raises(ValueError, match="key type"):
        lookup.number_columns("zz")


def test_left_lookup_with_hot_and_unique_keys(spark):
    """A third of the rows on one key, another hot key missing from the table."""
    rows = spark.range(30_000).select(
        "id", F.expr("CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'lost' ELSE string(id) END AS k")
    )
    table = spark.range(0, 30_000, 4).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    table = table.unionByName(spark.createDataFrame([("hot", -1)], "k string, v long"))
    assert {r.k for r in skew.hot_keys(rows, ["k"]).collect()} == {"hot", "lost"}
    got = skew.left_lookup(rows, table, ["k"])
    expected = rows.join(table, ["k"], "left")
    assert got.count() == 30_000
    assert got.select("id", "k", "v").exceptAll(expected.select("id", "k", "v")).count() == 0


def test_pair_lookup(spark, rows_of):
    stored = spark.createDataFrame([("9", "10", 4), ("1", "2", 5), ("2", "1", 6)], "n1 string, n2 string, frequency long")
    graded = spark.createDataFrame([(10, 9), (9, 10), (2, 1), (3, 3)], "x long, z long")
    assert rows_of(lookup.lookup_pair_frequency(graded, stored)) == [
        (2, 1, "('1', '2')", 5, 1),
        (3, 3, "('3', '3')", 0, 0),
        (9, 10, "('9', '10')", 4, 1),
        (10, 9, "('9', '10')", 4, 1),
    ]
    assert rows_of(lookup.pair_order_check(stored)) == [("1", "2", 5, 6)]
    assert rows_of(lookup.pair_digit_filter(stored, 1), "n1") == [("1",), ("2",), ("9",)]


def test_filters(spark, graded, rows_of):
    assert lookup.small_operand_filter(graded, 10).count() == 1
    zero = spark.createDataFrame([("a", 0), ("b", 3)], "k string, f long")
    assert rows_of(lookup.drop_zero_frequency(zero, "f", ["k"]), "k") == [("b",)]
    kept = rows_of(lookup.drop_zero_frequency(zero, "f", ["k"], drop=False), "f")
    assert 0 < kept[0][0] < 1 and kept[1][0] == 3.0
    parts = spark.createDataFrame([([24, 48],), ([24, 50],), ([5, 48],), ([72],)], "parts array<long>")
    assert rows_of(lookup.round_key_filter(parts)) == [([24, 48],), ([72],)]
    keys = ["23", "('24', '47')", "('5', 'minute')", "('5', '300', 'minute')"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    unit = F.col("key").contains("minute")
    got = [r.p for r in df.select(lookup.key_parts(F.col("key"), unit).alias("p")).collect()]
    assert got == [[23], [24, 47], [5], [5, 300]]


def test_jitter_is_uniform_and_repeatable(spark):
    values = spark.range(20_000).select(lookup.jitter("id").alias("v"), lookup.jitter("id").alias("w"))
    row = values.agg(F.min("v"), F.max("v"), F.avg("v"), F.sum((F.col("v") != F.col("w")).cast("int"))).first()
    assert 0 < row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.01 and row[3] == 0


def test_symmetry(spark, rows_of):
    graded = spark.createDataFrame([("mult", 1, 2, 2, 1), ("mult", 3, 3, 9, 0)], "word string, x long, y long, z long, is_correct int")
    assert rows_of(lookup.symmetry_union(graded), "x", "y", "z") == [(1, 2, 2), (2, 1, 2), (3, 3, 9)]
    assert rows_of(lookup.symmetry_check(graded, [1, 3])) == [(1, 1, 0, 1, 1), (3, 1, 1, 1, 1)]


def test_key_accuracy(graded, tables, rows_of):
    got = lookup.key_accuracy(graded, tables, "xy")
    assert rows_of(got, "word", "key", "parts", "frequency", "answers", "correct", "accuracy", "mean_x") == [
        ("comparemoreless", "('10', '9')", [10, 9], 4.0, 1, 0, 0.0, 10.0),
        ("mult", "('10', '10')", [10, 10], 2.0, 1, 1, 1.0, 10.0),
        ("mult", "('10', '9')", [10, 9], 4.0, 2, 1, 0.5, 9.0),
    ]
    assert lookup.key_accuracy(graded, tables, "xy", use_filter=True).count() == 0
    kept = lookup.key_accuracy(graded, tables, "xy", drop_zero=False)
    assert kept.count() == 6 and kept.where("frequency < 1").count() == 3
    both = lookup.key_accuracy(graded.where("word = 'mult'"), tables, "x", make_symmetry=True)
    assert rows_of(both, "key", "answers") == [("10", 4), ("9", 2)]
    assert rows_of(lookup.overall_accuracy(got, ["word"])) == [("comparemoreless", 1, 0.0), ("mult", 3, 2 / 3)]
    points = lookup.important_points(lookup.key_accuracy(graded, tables, "x"), [9])
    assert rows_of(points, "word", "label") == [("day", "9"), ("minute", "9"), ("mult", "9")]


def test_every_experiment_word_has_its_keyword(spark, tables):
    rows = spark.createDataFrame([("mode10hashtag", "gptj", 2, 9, 10, 9, 1), ("day", "gptj", 2, 9, 24, 216, 1)], GRADED)
    found = {r.word: r.lookup_frequency for r in lookup.lookup_frequency(rows, tables(1), "x").collect()}
    assert found == {"mode10hashtag": 7, "day": 8}
    assert lookup.key_accuracy(rows, tables, "x").count() == 2
    with pytest.raises(Exception, match="unknown experiment word: fortnight"):
        bad = spark.createDataFrame([("fortnight", "gptj", 2, 9, 10, 9, 1)], GRADED)
        lookup.lookup_frequency(bad, tables(1), "x").collect()


def test_operands_in_string_order(spark):
    rows = [(a, b, c) for a in (5, 10, 9) for b in (5, 10, 9) for c in (5, 10, 9)]
    df = spark.createDataFrame([("mult", *r) for r in rows], "word string, x long, y long, z long")
    for r in lookup.with_key(df, "xyz").collect():
        assert [r.n1, r.n2, r.n3] == sorted(map(str, (r.x, r.y, r.z)))
