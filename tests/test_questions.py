import pytest
from pyspark.sql import functions as F

from termgauge.operators import counting, grading, prompts, questions
from termgauge.sources import readers


@pytest.fixture(scope="module")
def constant(spark):
    return readers.constant_frequency(spark).cache()


@pytest.mark.parametrize(
    "factory,built,kept",
    [
        ("Num1Mult", 10_000, 10_000),
        ("Num1#*", 10_000, 10_000),
        ("Num1Plus", 10_000, 10_000),
        ("Num1#+", 10_000, 10_000),
        ("Num1Less", 9_901, 9_801),
        ("Num1More", 9_901, 9_801),
        ("Num1concat#", 5_000, 5_000),
        ("Num1mode10#", 100, 100),
        ("Num1MoreLess", 19_802, 19_602),
    ],
)
def test_sizes_with_constant_frequency(constant, factory, built, kept):
    rows = questions.operand_expand(constant, factory)
    assert rows.count() == built
    assert questions.digit_limit_filter(rows).count() == kept
    assert rows.where("frequency <> 100").count() == 0


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_operands(spark):
    term = spark.createDataFrame([("007", 3)], "n1 string, frequency long")
    row = questions.operand_expand(term, "Num1Mult").where("y = '6'")
    assert one(row, "key", "x", "z", "word", "math_operator") == [("007", "7", "42", "times", "*")]
    assert one(questions.operand_expand(term, "Num1concat#").where("y = '6'"), "x", "z") == [("007", "0076")]
    assert one(questions.operand_expand(term, "Num1mode10#"), "x", "y", "z") == [("007", "10", "7")]
    assert one(questions.operand_expand(term, "Num1More").where("y = '12'"), "x", "z") == [("7", "12")]
    assert questions.operand_expand(term, "Num1Less").where("y = '7'").count() == 0
    pair = spark.createDataFrame([("12", "7", 4)], "n1 string, n2 string, frequency long")
    assert one(questions.operand_expand(pair, "Num2Plus"), "key", "x", "y", "z") == [("('12', '7')", "12", "7", "19")]
    assert one(questions.operand_expand(pair, "Num2#*"), "z", "word") == [("84", "#")]
    unit = spark.createDataFrame([("5", "week", 4), ("5", "plus", 1)], "n1 string, keyword string, frequency long")
    for rows in (questions.time_unit(unit), questions.operand_expand(unit, "Week1")):
        assert one(rows, "factory_type", "key", "x", "y", "z", "word") == [
            ("Week1", "('5', 'week')", "5", "7", "35", "week")
        ]
    assert questions.operand_expand(unit, "Day1").count() == 0
    with pytest.raises(ValueError, match="Num1Mult"):
        questions.operand_expand(term, "Num1")


def test_questions(spark):
    term = spark.createDataFrame([("5", 3)], "n1 string, frequency long")
    points = questions.datapoints(questions.operand_expand(term, "Num1MoreLess").where("y = '12'"))
    assert sorted(one(points, "question", "answer")) == [
        ("Which one is higher? 5 or 12", "12"),
        ("Which one is lower? 5 or 12", "5"),
    ]
    points = questions.datapoints(questions.operand_expand(term, "Num1#+").where("y = '12'"))
    assert one(points, "question", "answer") == [("What is 5 # 12?", "17")]
    both = questions.datapoints(
        questions.operand_expand(term, "Num1Plus").where("y = '1'"), templates=["Num1Plus", "Num1#+"]
    )
    assert one(both, "question") == [("What is 5 plus 1?",), ("What is 5 # 1?",)]
    unit = spark.createDataFrame([("5", "decade", 4)], "n1 string, keyword string, frequency long")
    assert one(questions.datapoints(questions.time_unit(unit)), "question", "answer") == [
        ("What is 5 decades in years?", "50")
    ]


def test_question_numbers(spark):
    rows = [("What is 5 times 12?",), ("Which one is lower? 5 or 12",), ("What is 007 # 1?",), ("",)]
    df = spark.createDataFrame(rows, "q string").select(questions.question_numbers(F.col("q")).alias("n"))
    assert [r.n for r in df.collect()] == [[5, 12], [5, 1], [7, 1], []]


def points(spark, *rows):
    schema = "seed int, factory_type string, question string, key string, answer string, x string, y string, draw string"
    filled = [(0, f, q, str(i), a, x, y, f"{i:03}") for i, (f, q, a, x, y) in enumerate(rows)]
    return spark.createDataFrame(filled, schema)


def test_prompt(spark):
    train = points(spark, ("Num1Mult", "What is 2 times 3?", "6", "2", "3"))
    test = points(spark, ("Num1Mult", "What is 4 times 5?", "20", "4", "5"))
    body = prompts.render_prompt(test, train).first().body
    assert body == "Q: What is 2 times 3?\nA: 6\n\nQ: What is 4 times 5?\nA:"
    titled = prompts.render_prompt(test, train.limit(0), title="Title").first().body
    assert titled == "Title\n\nQ: What is 4 times 5?\nA:"


def test_leakage(spark):
    mult = lambda x, y: ("Num1Mult", f"What is {x} times {y}?", str(x * y), str(x), str(y))
    less = lambda x, y: ("Num1Less", f"Which one is lower? {x} or {y}", "", str(x), str(y))
    train = points(spark, mult(5, 12), less(5, 12))
    test = points(spark, mult(12, 5), mult(5, 13), mult(5, 1), less(5, 13), less(5, 22))
    kept = {r.question for r in prompts.leakage_filter(test, train).collect()}
    assert kept == {"What is 5 times 13?", "Which one is lower? 5 or 22"}
    kept = {r.question for r in prompts.leakage_filter(test, train, faithful=False).collect()}
    assert kept == {r.question for r in test.collect()} - {"What is 12 times 5?"}
    assert prompts.leakage_filter(test, train.limit(0)).count() == 5


def test_split(constant):
    rows = questions.datapoints(questions.operand_expand(constant, "Num1MoreLess"))
    seeded = prompts.multi_seed(rows, 3)
    train, test = prompts.split_shots_grouped(seeded, 5, ["Num1More", "Num1Less"])
    counts = {(r.seed, r.factory_type): r["count"] for r in train.groupBy("seed", "factory_type").count().collect()}
    assert counts == {(s, f): n for s in range(3) for f, n in (("Num1More", 3), ("Num1Less", 2))}
    assert train.count() + test.count() == seeded.count()
    assert train.join(test, list(prompts.ROW_ID)).count() == 0
    first = {tuple(r) for r in train.select("seed", "question").collect()}
    assert len({q for _, q in first}) > 10  # seeds draw differently
    assert first == {tuple(r) for r in train.select("seed", "question").collect()}
    zero, rest = prompts.split_shots(seeded, 0)
    assert zero.count() == 0 and rest.count() == seeded.count()


def test_split_drops_rows_before_the_shuffle(constant):
    rows = prompts.multi_seed(questions.datapoints(questions.num1_mult(constant)))
    train, test = prompts.split_shots(rows, 2)
    assert "WindowGroupLimit" in train._jdf.queryExecution().executedPlan().toString()
    # The test side is an anti join with the shots and ranks nothing but them.
    assert "BroadcastHashJoin" in test._jdf.queryExecution().executedPlan().toString()


def test_grading(spark):
    rows = [("p", "p 20 Q:", "20"), ("p", "p 20. Q", "20"), ("p", "p", "20"), ("p", "p   7", " 7 "), ("p", "pX7 1", "7")]
    graded = grading.grade_completions(spark.createDataFrame(rows, "body string, full_text string, answer string"))
    assert one(graded, "generated_answer", "is_correct") == [("20", 1), ("20.", 0), (None, 0), ("7", 1), ("7", 1)]


def test_experiment_end_to_end(spark, constant):
    terms = counting.top_terms(constant, 10)
    points_ = questions.datapoints(questions.operand_expand(terms, "Num1MoreLess"))
    cases = prompts.testcases(points_, shots=4, seeds=2, groups=["Num1More", "Num1Less"])
    full = cases.withColumn("full_text", F.concat("body", F.lit(" "), "answer", F.lit(" end")))
    graded = grading.grade_completions(full)
    accuracy = grading.accuracy_by_key(graded)
    totals = accuracy.agg(F.sum("total"), F.sum("correct")).first()
    assert totals[0] == totals[1] == cases.count()
    assert cases.where("body NOT LIKE 'Q: %A: %Q: %A:'").count() == 0
    flat = grading.flatten_results(grading.nest_results(graded))
    assert "testcase.data_point.frequency_data.key" in flat.columns
