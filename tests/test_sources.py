import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from termgauge.operators import counting, grading, questions, windows
from termgauge.sources import readers, writers
from termgauge.streaming import incremental


def test_json_corpus_and_windows(spark, tmp_path, rows_of):
    lines = [{"text": "1 plus 2", "meta": {"set": "a"}}, {"text": "3 ² 4\n5", "meta": {"set": "b"}}]
    (tmp_path / "00.jsonl").write_text("\n".join(json.dumps(line) for line in lines))
    corpus = readers.read_corpus(spark, str(tmp_path / "*.jsonl"))
    assert [json.loads(m) for (m,) in rows_of(corpus, "meta")] == [{"set": "a"}, {"set": "b"}]
    out = str(tmp_path / "windows")
    writers.write_windows(windows.number_windows(corpus), out, max_lines=2)
    parts = list((tmp_path / "windows").glob("part-*"))
    assert all(len(p.read_text().splitlines()) <= 2 for p in parts) and len(parts) >= 3
    assert set(json.loads(parts[0].read_text().splitlines()[0])) == {"meta", "text", "middle"}
    back = readers.read_windows(spark, out)
    assert rows_of(counting.num_co_occurrence_in_windows(back)) == rows_of(counting.num_co_occurrence(corpus))


def test_printed_counts(spark, tmp_path, rows_of):
    lines = ["('24', 123)", "('05', 4)", ""]
    (tmp_path / "a").write_text("\n".join(lines))
    assert rows_of(readers.read_counts(spark, str(tmp_path / "a"), format="text")) == [("05", 4), ("24", 123)]
    (tmp_path / "b").write_text("(('12', '7'), 45)\n")
    assert rows_of(readers.read_counts(spark, str(tmp_path / "b"), 2, format="text")) == [("12", "7", 45)]
    (tmp_path / "c").write_text("(('5', 'minute'), 9)\n(('5', '*'), 2)\n(('6', '+'), 3)\n(('6', '-'), 1)\n")
    counts = readers.read_counts(spark, str(tmp_path / "c"), 1, keyword=True, format="text")
    assert rows_of(counts) == [("5", "*", 2), ("5", "minute", 9), ("6", "+", 3), ("6", "-", 1)]
    top = readers.read_frequency(spark, str(tmp_path / "c"), 2, 1, keyword=True, format="text")
    assert [r.frequency for r in top.collect()] == [9, 3]
    writers.write_count_lines(counts, str(tmp_path / "again"))
    assert rows_of(readers.read_counts(spark, str(tmp_path / "again"), 1, keyword=True, format="text")) == rows_of(counts)
    out = tmp_path / "by_keyword"
    writers.write_counts_by_keyword(counts, str(out))
    names = {p.name for p in out.iterdir() if p.is_dir()}
    assert names == {f"keyword_file={n}" for n in ("minute", "sign_multiply", "sign_plus", "sign_minus")}


def test_sorted_counts_are_in_file_order(spark, tmp_path):
    counts = spark.range(5000).selectExpr("string(id) AS n1", "pmod(id * 7919, 5003) AS frequency")
    writers.write_sorted_counts(counts, str(tmp_path / "s"))
    found = []
    for part in sorted((tmp_path / "s").glob("part-*")):
        found += [r.frequency for r in spark.read.parquet(str(part)).collect()]
    assert found == sorted(found, reverse=True) and len(found) == 5000


@pytest.fixture
def results(spark):
    terms = readers.constant_frequency(spark, 2, 4)
    rows = questions.datapoints(questions.num1_mult(terms)).limit(50)
    rows = rows.withColumn("body", F.lit('Q: say "1, 2"\nA: 3\n\nQ: x\nA:'))
    rows = rows.withColumn("full_text", F.concat("body", F.lit(" "), "answer", F.lit(", Q:")))
    return grading.flatten_results(grading.nest_results(grading.grade_completions(rows)))


def test_results_round_trip(spark, tmp_path, results):
    path = str(tmp_path / "r.csv")
    writers.write_results(results, path)
    with pytest.raises(Exception, match="already exists"):
        writers.write_results(results, path)
    writers.write_results(results, path, "append")
    back = readers.read_results(spark, path)
    assert back.count() == 100
    assert {r.body for r in back.select("body").collect()} == {'Q: say "1, 2"\nA: 3\n\nQ: x\nA:'}
    assert dict(back.dtypes)["z"] == "bigint" and back.agg(F.sum("is_correct")).first()[0] == 0
    accuracy = grading.accuracy_by_key(back.drop("seed"), by=())
    target = writers.write_accuracy_by_key(accuracy, path)
    assert target.endswith("r.agg.csv") and spark.read.csv(target, header=True).count() == accuracy.count()
    writers.write_results(results, path, "overwrite")
    assert readers.read_results(spark, path).count() == 50


def test_results_with_an_index_column(spark, tmp_path):
    head = ",generated_answer,is_correct,testcase.body,testcase.data_point.frequency_data.x,testcase.data_point.frequency_data.frequency"
    (tmp_path / "f.csv").write_text(head + '\n0,7,True,"Q: a\nA:",5,100\n1,8,False,b,6,100\n')
    back = readers.read_results(spark, str(tmp_path / "f.csv"))
    assert [tuple(r) for r in back.orderBy("x").collect()] == [("7", 1, "Q: a\nA:", 5, 100), ("8", 0, "b", 6, 100)]


def test_frequency_tables(spark, rows_of):
    opened = []

    def numbers(k):
        opened.append(k)
        return spark.createDataFrame([("5", 9)], "n1 string, frequency long")

    def words(k):
        return spark.createDataFrame([("5", "minute", 2), ("5", "day", 3)], "n1 string, keyword string, frequency long")

    tables = readers.FrequencyTables(numbers, words)
    assert rows_of(tables.frequency_for("mult"), "n1", "keyword", "frequency") == [("5", "", 9)]
    assert rows_of(tables.frequency_for("comparemoreless"), "keyword") == [("",)]
    assert rows_of(tables.frequency_for("day"), "keyword", "frequency") == [("day", 3)]
    assert tables.all().count() == 3 and opened == [1]


def test_stream_of_new_files(spark, tmp_path, rows_of):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "text string, meta string"
    texts = ["1 2 3", "2 1 days", "3 3"]

    def run():
        corpus = spark.readStream.schema(schema).json(source)
        incremental.incremental_counts(corpus, out, state).awaitTermination()
        return rows_of(incremental.read_incremental_counts(spark, out))

    frame = lambda *t: spark.createDataFrame([(x, "{}") for x in t], schema)
    frame(texts[0]).write.mode("append").json(source)
    assert run() == rows_of(counting.num_co_occurrence(frame(texts[0])))
    frame(*texts[1:]).write.mode("append").json(source)
    assert run() == rows_of(counting.num_co_occurrence(frame(*texts)))
    assert run() == rows_of(counting.num_co_occurrence(frame(*texts)))  # nothing new


def test_shared_dir(spark):
    from termgauge import session

    assert session.shared_dir(spark) == session.shared_dir(spark)
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        assert session.shared_dir(spark).startswith(configured)


@pytest.mark.parametrize("line", ["('24', x)", "('24', 1", "nonsense", "(('1', '2'), 3)", "('1', 3) trailing"])
def test_a_count_that_cannot_be_read_is_an_error(spark, tmp_path, line):
    (tmp_path / "a").write_text(f"('1', 2)\n{line}\n")
    with pytest.raises(Exception, match="not a count"):
        readers.read_counts(spark, str(tmp_path / "a"), format="text").collect()


def test_quotes_of_counts(spark, tmp_path, rows_of):
    (tmp_path / "a").write_text("(\"24\", 1)\n  \n('it', 2)\n")
    assert rows_of(readers.read_counts(spark, str(tmp_path / "a"), format="text")) == [("24", 1), ("it", 2)]


def test_broken_json_is_an_error(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "1 plus 2", "meta": "m"}\n{"text": "3 plus\n')
    for read in (readers.read_corpus, readers.read_windows):
        with pytest.raises(Exception, match="(?i)malformed|parse"):
            read(spark, str(tmp_path / "a.jsonl")).collect()
    with pytest.raises(ValueError, match="format"):
        readers.read_corpus(spark, str(tmp_path / "a.jsonl"), format="csv")


def test_numbers_of_results_that_cannot_be_read(spark, tmp_path):
    head = "generated_answer,is_correct,testcase.data_point.frequency_data.x"
    for line, told in (("7,True,five", "no number"), ("7,perhaps,5", "no truth value")):
        path = tmp_path / f"{told}.csv"
        path.write_text(f"{head}\n{line}\n")
        with pytest.raises(Exception, match=told):
            readers.read_results(spark, str(path)).collect()


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "64")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_records_of_many_splits(spark, tmp_path, small_splits):
    """Splits of 64 bytes, so that quotes open and close in any of them and some records fill several."""
    rng = random.Random(3)
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [["no", "body"]]
        for i in range(120):
            parts = [rng.choice(["word", 'say ""', "x,y", "\n", "\r\n", '"', ""]) for _ in range(rng.choice([0, 1, 3, 60]))]
            rows.append([str(i), " ".join(parts)])
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as file:
            csv.writer(file, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
        want += rows
    records = readers.csv_records(spark, str(tmp_path))
    lines = spark.read.text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 50
    got = records.collect()
    read = [next(csv.reader(io.StringIO(r.record, newline=""))) for r in got]
    assert sorted(read) == sorted(want) and sum(r.first for r in got) == 2
    assert {r.record for r in got if r.first} == {"no,body"}


def test_results_over_many_splits(spark, tmp_path, results, small_splits):
    path = str(tmp_path / "r.csv")
    writers.write_results(results, path)
    back = readers.read_results(spark, path)
    assert back.count() == 50 and {r.body for r in back.collect()} == {'Q: say "1, 2"\nA: 3\n\nQ: x\nA:'}


def test_broken_results_are_errors(spark, tmp_path):
    (tmp_path / "open.csv").write_text('generated_answer,is_correct\n7,True\n"8,False\n')
    with pytest.raises(ValueError, match="never closed"):
        readers.read_results(spark, str(tmp_path / "open.csv"))
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("generated_answer,is_correct\n7,True\n")
    (tmp_path / "two" / "b.csv").write_text("is_correct,generated_answer\nTrue,7\n")
    with pytest.raises(Exception, match="another header"):
        readers.read_results(spark, str(tmp_path / "two")).collect()
