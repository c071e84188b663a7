import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termgauge.functions import text as tx
from termgauge.operators import counting, lookup, models, skew, tuples
from termgauge.plans import derived

ODD = [
    None, "", " \t ", "1", " 1 2 minutes 3\x1c4 ", "٣ 1234567 MINUTEſ 05 5 days plus * 7",
    "x 9 10 1 + 2 3 4 - 5 6", "1 plus", "plus 1", "\U00011f51 1 day", "6 1 6 week 6",
]


def counted(keys):
    return {tuple(r)[:-1]: r[-1] for r in counting.count_by_key(keys).collect()}


@pytest.mark.parametrize("many", [False, True])
def test_blocks_count_what_single_keys_count(corpus_of, spark, monkeypatch, many):
    """Texts cut into blocks of a few bytes, with odd blanks, digits and keywords of both kinds."""
    monkeypatch.setattr(tuples, "BLOCK_BYTES", 24)
    corpus = corpus_of(*ODD * 3)
    words = tx.DEFAULT_KEYWORDS
    if many:
        words = tx.Keywords([*words.specs, *[(f"word{i}", True) for i in range(tx.MOST_ALTERNATIVES)]])
        assert words.listed
    numbers, keywords = counting.number_anchors(corpus), counting.keyword_anchors(corpus, words)
    plain = lambda counts: {tuple(r)[:-1]: r[-1] for r in counts.collect()}
    if not many:
        assert plain(counting.num_co_occurrence(corpus, 3)) == counted(counting.co_occurrence_keys(numbers, 3))
        assert plain(counting.arithmetic_pattern(corpus)) == counted(counting.arithmetic_keys(numbers))
    got = plain(counting.word_num_occurrence(corpus, 2, keywords=words))
    assert got and got == counted(counting.word_number_keys(numbers, 2, keywords=words))
    assert plain(counting.word_num_occurrence_original(corpus, 2, keywords=words)) == counted(counting.keyword_centred_keys(keywords, 2))


def test_long_batches_are_cut(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tuples, "BLOCK_BYTES", 10)
    texts = ["aaaa", None, "b" * 50, "", "cc", "dddddddd", "e"]
    blocks = list(tuples._blocks(iter([pa.RecordBatch.from_arrays([pa.array(texts[i : i + 3])], ["text"]) for i in (0, 3, 6)])))
    assert [t for b in blocks for t in b.to_pylist()] == [t for t in texts if t is not None]
    assert all(len(b) == 1 or sum(len(t) for t in b.to_pylist()) <= 60 for b in blocks) and len(blocks) > 1


def test_operand_sums_give_the_same_keys(spark):
    rows = [("plus", m, 2, x, y, x + y, (x * y) % 2) for m in "ab" for x in range(4) for y in range(3)] * 2
    graded = spark.createDataFrame(rows + [("hour", "a", 2, 1, 60, 60, None)], "word string, model string, shots int, x long, y long, z long, is_correct int")
    table = spark.createDataFrame([("1", "1", "", 5), ("0", "2", "", 7), ("1", "60", "hour", 3), ("8", "9", "", 4)], "n1 string, n2 string, keyword string, frequency long")
    for changes in ({}, {"make_symmetry": True, "drop_zero": False}):
        parts = [lookup.key_accuracy(g, lambda n: table, "xy", **changes) for g in (graded, lookup.operand_sums(graded))]
        one, other = (sorted(map(str, p.collect())) for p in parts)
        assert one == other and one


@pytest.mark.parametrize("few", [0, 2, 100])
def test_asked_lookup(spark, rows_of, monkeypatch, few):
    monkeypatch.setattr(skew, "FEW_KEYS", few)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "k string, v int")
    table = spark.createDataFrame([("a", 10), ("b", 20), ("z", 30)], "k string, f int")
    got = skew.asked_lookup(rows, table, ["k"])
    assert {r.v: r.f for r in got.collect()} == {1: 10, 2: 10, 3: 20, 4: None, 5: None}
    assert rows_of(skew.asked_part(rows, table, ["k"])) == [("a", 10), ("b", 20)]


@pytest.mark.parametrize("levels, slope", [(1, -1.0), (40, -0.2), (700, -0.2), (700, -4.0)])
def test_likelihood_over_condensed_levels(levels, slope, monkeypatch):
    chains = models._Chains(["g"], 2000, 1000, 2, 0, 4)
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"g": ["a"] * levels, "t": rng.random(levels) * 10, "answers": rng.integers(1, 500, levels), "m0": slope, "m1": 5.0, "v00": 0.5, "v01": -0.2, "v11": 0.5, "mode0": slope, "mode1": 5.0})
    rows["correct"] = (rows.answers * rng.random(levels)).astype(int)
    most = []
    summed = models._softplus_sums
    monkeypatch.setattr(models, "_softplus_sums", lambda a, b, t, n: most.append(len(a) * len(t)) or summed(a, b, t, n))
    got = chains.log_likelihood(rows)
    proposed, _ = models._proposals(rows.iloc[0], np.random.default_rng(models._cell_seed(("a",), 0)), 2000)
    eta = proposed[:, :1] * rows.t.to_numpy() + proposed[:, 1:]
    want = (rows.correct.to_numpy() * eta - rows.answers.to_numpy() * np.logaddexp(0, eta)).sum(axis=1)
    assert np.allclose(got, want, rtol=1e-12, atol=1e-7)
    if levels == 700 and slope == -0.2:
        assert sum(most) < 2000 * levels / 4


def test_counts_of_one_pass(corpus_of, spark):
    """All sizes in one pass, with keys that are no integer: digits of other scripts, leading zeros, more than three numbers."""
    corpus = corpus_of(*ODD, "007 07 7 ١٢ 123456 day ٣", "1 02 3 04 5")
    plain, keyed = counting.frequency_counts(corpus, [1, 2, 3, 4], [1, 3])
    got = lambda counts: {tuple(r)[:-1]: r[-1] for r in counts.collect()}
    anchors = counting.number_anchors(corpus)
    for k, counts in plain.items():
        assert counts.columns == [*[f"n{i + 1}" for i in range(k)], "frequency"]
        assert got(counts) and got(counts) == counted(counting.co_occurrence_keys(anchors, k))
    for k, counts in keyed.items():
        assert got(counts) and got(counts) == counted(counting.word_number_keys(anchors, k))
    assert not counting.frequency_counts(corpus_of("no number"), [1], [1])[1][1].collect()


def test_counts_of_a_block_travel_as_one_row_for_each_part(corpus_of, spark, monkeypatch):
    """Spark groups no single keys, and the counts of all blocks are added up."""
    monkeypatch.setattr(tuples, "BLOCK_BYTES", 1 << 12)
    corpus = corpus_of(*[f"{i % 300} day {i % 7} and {i % 11} plus {i}" for i in range(3000)])
    plan = tuples.count(corpus, ["n1"], lambda b: tuples.number_tuples(b, 1, 5), 5)._jdf.queryExecution().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") >= 2
    plain, keyed = counting.frequency_counts(corpus, [1, 3], [2])
    anchors = counting.number_anchors(corpus)
    got = lambda counts: {tuple(r)[:-1]: r[-1] for r in counts.collect()}
    assert got(plain[3]) == counted(counting.co_occurrence_keys(anchors, 3))
    assert got(keyed[2]) == counted(counting.word_number_keys(anchors, 2))
    assert len(got(plain[1])) == plain[1].count() == 3000


def test_sums_of_parts(monkeypatch):
    """Blocks whose lists of keywords differ; keys that are no integer; parts that lie across batches."""
    import pyarrow as pa

    blocks = [(["day", "plus"], [1, 0, 1]), (["plus"], [0, 0, 0])]
    batches = []
    for stems, words in blocks:
        code, odd = pa.array([5, 5, None], pa.int64()), pa.array([None, None, "007 07"], pa.string())
        batches += tuples._sent(1, stems, code, odd, np.array(words), np.array([1, 2, 4]), 1)
        batches += tuples._sent(0, [], code.slice(0, 1), odd.slice(0, 1), None, np.array([1 << 40]), 1)
    got = sorted((tuple(r.values()) for b in tuples._summed(iter(batches)) for r in b.to_pylist()), key=str)
    assert got == [(0, 5, None, None, 2 << 40), (1, 5, None, "day", 2), (1, 5, None, "plus", 4), (1, None, "007 07", "plus", 8)]


@pytest.fixture
def given(spark, tmp_path):
    lines = [(o, p, s, o % 7, float(o % 50 + 1)) for o, p, s in ((i, i % 90, 3 if i % 10 else i % 40) for i in range(2000))]
    lines = spark.createDataFrame([*lines, (None, None, None, None, None)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    docs = spark.createDataFrame([(1, "the cat of a b and was it", "en", "web"), (2, None, "de", "web")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_keys_read_the_corpus_once(spark, given, monkeypatch):
    passes, count_all = [], tuples.count_all
    monkeypatch.setattr(tuples, "count_all", lambda texts, counts, *rest: passes.append(len(counts)) or count_all(texts, counts, *rest))
    tables = derived.Tables(spark, given)
    tables.count(range(1, 4), range(1, 4))
    assert tables.numbers(2).count() and tables.words(3).count()
    tables.frequencies.all(1).count()
    assert passes == [6]
    assert not {"lines", "documents"} & set(tables._written)


def test_lines_of_a_hot_supplier_are_divided(spark, given):
    """Lines are next to those of the same supplier, in parts of about the same size."""
    rows = derived.Tables(spark, given)._by_supplier().select("*", F.spark_partition_id().alias("part"))
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert sum(sizes) == 2001 and max(sizes) < 2001 / 2
    edges = rows.groupBy("part").agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high")).orderBy("low", "high").collect()
    assert all(a.high <= b.low for a, b in zip(edges, edges[1:]))


def test_rows_are_dealt_without_a_sort(spark, given):
    rows = derived.Tables(spark, given)._dealt("lineitem", derived.LINE_COLUMNS)
    plan = rows._jdf.queryExecution().toString()
    assert "hashpartitioning" in plan and "RoundRobin" not in plan
    assert rows.count() == 2001


def test_rows_of_a_task_are_sorted_by_one_integer(spark, given):
    plan = derived.Tables(spark, given)._by_supplier()._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert len(sorts) == 1 and sorts[0].count("ASC") == 1


def by_rule_of_sql(documents):
    """Documents as SQL writes them, token by token."""
    rule = derived.WORD_RULE.replace("word", "w")
    text = f"array_join(transform(tokens, (w, i) -> concat(CASE i % 16 WHEN 0 THEN '\n' WHEN 8 THEN '\u00a0' ELSE ' ' END, {rule})), '')"
    meta = "concat('{\"lang\":\"', lang, '\",\"source\":\"', source, '\"}') AS meta"
    return documents.select("*", tx.tokenize(F.col("text")).alias("tokens")).selectExpr("-1 - doc_id AS doc_id", f"{text} AS text", meta)


def test_documents_are_written_as_in_sql_and_each_word_is_ruled_once(spark, rows_of, monkeypatch):
    texts = [None, "", " \n\u00a0", "the", "the of and la der de that was The THE", "a zz zzz zzzz Zz \u00e9t z\u00fc 1a -ab ab-"]
    texts += [" ".join(["wort", "so", "it", "UND"] * 20), "a\u2003b\x1cc\x85d\u3000 e\u200bf ", "\u0130 ma\u00dfe \u0661\u0662 x\x00y"]
    rows = [(i if i != 3 else None, t, None if i == 4 else "en", "web") for i, t in enumerate(texts)] + [(7, texts[6], "en", None)] * 2
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    key = lambda rows: sorted(rows, key=repr)
    written = derived.write_documents(documents)
    assert key(written.collect()) == key(by_rule_of_sql(documents).collect())
    assert written.dtypes == by_rule_of_sql(documents).dtypes
    asked = []
    monkeypatch.setattr(derived, "ruled", lambda w: asked.append(w) or w)
    derived._written(pa.array(["one two one", "two one"]))
    assert sorted(asked) == ["one", "two"]
