"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termgauge.functions import dimensions as dims
from termgauge.functions import text as tx
from termgauge.operators import accuracy as acc
from termgauge.operators import counting, farthest, grading, lookup, models, prompts, questions, windows
from termgauge.plans import derived, reports
from termgauge.plans.derived import Tables
from termgauge.session import materialise, new_path
from termgauge.sources import readers, writers
from termgauge.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register a function of the derived tables under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables.of(spark, sf_dir))
        return build

    return register


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that add in another order give the same value.

    The small shift takes fractions such as 5/128 off the tie between two rounded values.
    """
    doubles = {f.name for f in rows.schema if f.dataType.typeName() == "double"}
    return rows.select(
        *[F.round(F.col(f"`{c}`") + 1e-9, digits).alias(c) if c in doubles else F.col(f"`{c}`") for c in rows.columns]
    )


def checksum(text: Column) -> Column:
    """Sum over the rows of a group of the first 32 bits of the MD5 of ``text``."""
    return F.sum(F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint")).alias("checksum")


def n_rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


# ---------------------------------------------------------------- text

tokens_of = lambda t: windows.token_positions(t.corpus).select("token")


@query("tokenize")
def _(t):
    return tokens_of(t).groupBy("token").agg(n_rows())


@query("is_number")
def _(t):
    numbers = tokens_of(t).where(tx.is_number(F.col("token")))
    return numbers.groupBy(F.length("token").cast("bigint").alias("digits")).agg(n_rows())


@query("match_keyword")
def _(t):
    found = tokens_of(t).select("token", tx.DEFAULT_KEYWORDS.match(F.col("token")).alias("keyword"))
    return found.where("keyword IS NOT NULL").groupBy("token", "keyword").agg(n_rows())


@query("text_windows")
def _(t):
    rows = windows.text_windows(t.corpus)
    return rows.groupBy(F.length("middle").cast("bigint").alias("length")).agg(
        n_rows(), checksum(F.array_join("window", " "))
    )


@query("surrounding_search")
def _(t):
    name = lambda token: F.when(token.rlike("^[A-Z][a-z]{1,3}$"), token)
    rows = windows.surrounding_search(t.corpus, 4, name)
    return rows.groupBy("match").agg(n_rows(), checksum(F.array_join("window", " ")))


@query("number_windows")
def _(t):
    rows = windows.number_windows(t.corpus)
    return rows.groupBy("meta", "middle").agg(n_rows(), checksum(F.col("text")))


@query("keyword_windows")
def _(t):
    rows = windows.keyword_windows(t.corpus)
    return rows.groupBy("match", "meta").agg(n_rows(), checksum(F.array_join("window", " ")))


@query("number_keyword_patterns")
def _(t):
    rows = windows.number_keyword_patterns(t.corpus)
    span = F.regexp_replace("span", tx.WS, " ").alias("span")
    return rows.groupBy(span, "keyword", "alternative").agg(n_rows())


# ---------------------------------------------------------------- counts

query("num_occurrence")(lambda t: counting.num_occurrence(t.corpus))
query("num_co_occurrence")(lambda t: counting.num_co_occurrence(t.corpus, 2))
query("num_co_occurrence_k3")(lambda t: counting.num_co_occurrence(t.corpus, 3))
query("word_num_occurrence")(lambda t: counting.word_num_occurrence(t.corpus, 1))
query("word_num_occurrence_k2")(lambda t: counting.word_num_occurrence(t.corpus, 2))
query("word_num_occurrence_original")(lambda t: counting.word_num_occurrence_original(t.corpus, 1))
query("word_num_occurrence_original_k2")(lambda t: counting.word_num_occurrence_original(t.corpus, 2))
query("arithmetic_pattern")(lambda t: counting.arithmetic_pattern(t.corpus))
query("num_co_occurrence_in_windows")(
    lambda t: counting.num_co_occurrence_in_windows(windows.number_windows(t.corpus), 2)
)
query("word_num_occurrence_in_windows")(
    lambda t: counting.word_num_occurrence_in_windows(windows.number_windows(t.corpus), 1)
)
query("arithmetic_pattern_in_windows")(
    lambda t: counting.arithmetic_pattern_in_windows(windows.number_windows(t.corpus))
)


@query("count_by_key")
def _(t):
    return counting.count_by_key(t.graded.select("word", "model", "shots", "key"))


@query("merge_counts")
def _(t):
    shards = [counting.num_co_occurrence(part, 2) for part in (t.lines, t.documents)]
    return counting.merge_counts(*shards)


query("distinct_keywords")(lambda t: counting.distinct_keywords(t.words(1)))
query("sort_by_frequency")(lambda t: counting.sort_by_frequency(t.words(1)))
query("top_terms")(lambda t: counting.top_terms(t.numbers(2), 200))
query("top_terms_per_keyword")(
    lambda t: counting.top_terms_per_keyword(t.words(1), 200).withColumn("rank", F.col("rank").cast("bigint"))
)


@query("incremental_counts")
def _(t):
    state = new_path(t.spark, "stream-state")
    out = new_path(t.spark, "stream-counts")

    def stream(table, name):
        schema = t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet").schema
        return table(t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}*.parquet"))

    lines = stream(derived.write_lines, "lineitem")
    corpus = lines.unionByName(stream(derived.write_documents, "documents"))
    incremental.incremental_counts(corpus, out, state).awaitTermination()
    return incremental.read_incremental_counts(t.spark, out)


query("word_num_occurrence_k3")(lambda t: t.words(3))


# ---------------------------------------------------------------- sources and sinks


@query("read_corpus")
def _(t):
    path = new_path(t.spark, "corpus-json")
    t.corpus.select("text", "meta").write.json(path)
    corpus = readers.read_corpus(t.spark, path)
    return corpus.groupBy("meta").agg(n_rows(), checksum(F.col("text")))


@query("read_windows")
def _(t):
    path = new_path(t.spark, "windows-json")
    writers.write_windows(windows.number_windows(t.corpus), path)
    return counting.num_co_occurrence_in_windows(readers.read_windows(t.spark, path), 2)


@query("write_windows")
def _(t):
    path = new_path(t.spark, "windows-json")
    writers.write_windows(windows.number_windows(t.corpus), path, max_lines=10_000)
    return readers.read_windows(t.spark, path).groupBy("middle").agg(n_rows(), checksum(F.col("text")))


@query("read_counts")
def _(t):
    path = new_path(t.spark, "count-lines")
    writers.write_count_lines(t.words(2), path)
    return readers.read_counts(t.spark, path, 2, keyword=True, format="text")


@query("read_frequency")
def _(t):
    path = new_path(t.spark, "count-lines")
    writers.write_count_lines(t.numbers(1), path)
    return readers.read_frequency(t.spark, path, 200, format="text")


@query("constant_frequency")
def _(t):
    constant = readers.constant_frequency(t.spark)
    counted = t.numbers(1).withColumnRenamed("frequency", "counted")
    return constant.join(counted, "n1", "left")


@query("read_results")
def _(t):
    path = new_path(t.spark, "results-csv")
    writers.write_results(grading.flatten_results(grading.nest_results(graded_testcases(t))), path)
    rows = readers.read_results(t.spark, path)
    return rows.groupBy("key", "frequency").agg(
        n_rows(), F.sum("is_correct").cast("bigint").alias("correct"), F.sum("z").alias("z"), checksum(F.col("body"))
    )


@query("frequency_for")
def _(t):
    parts = [t.frequencies.frequency_for(word, 1).withColumn("word", F.lit(word)) for word in derived.WORDS]
    return functools.reduce(DataFrame.unionByName, parts)


@query("write_counts")
def _(t):
    path = new_path(t.spark, "counts") + ".parquet"
    writers.write_counts(counting.arithmetic_pattern(t.corpus), path)
    return readers.read_counts(t.spark, path)


@query("write_sorted_counts")
def _(t):
    path = new_path(t.spark, "sorted-counts") + ".parquet"
    writers.write_sorted_counts(t.numbers(2), path)
    return readers.read_counts(t.spark, path)


@query("write_counts_by_keyword")
def _(t):
    path = new_path(t.spark, "keyword-counts")
    writers.write_counts_by_keyword(t.words(1), path)
    return t.spark.read.parquet(path)


@query("write_results")
def _(t):
    path = new_path(t.spark, "results") + ".csv"
    results = grading.flatten_results(grading.nest_results(graded_testcases(t)))
    writers.write_results(results.where("seed < 2"), path, "overwrite")
    writers.write_results(results.where("seed >= 2"), path, "append")
    rows = t.spark.read.csv(path, header=True, escape='"', multiLine=True)
    return rows.select("seed", "is_correct", F.md5(F.col("`testcase.body`")).alias("body"), F.col("`testcase.data_point.question`").alias("question"))


@query("write_accuracy_by_key")
def _(t):
    path = new_path(t.spark, "results") + ".csv"
    target = writers.write_accuracy_by_key(grading.accuracy_by_key(t.graded), path)
    schema = "seed int, key string, frequency long, correct long, total long, accuracy double"
    return rounded(t.spark.read.schema(schema).csv(target, header=True))


@query("write_report")
def _(t):
    path = new_path(t.spark, "report")
    report = reports.gap_report_arithmetic(t.keys)
    writers.write_report(report, path)
    return rounded(t.spark.read.schema(report.schema).csv(path, header=True))


# ---------------------------------------------------------------- questions


def terms(t: Tables) -> DataFrame:
    return counting.top_terms(t.numbers(1), 200)


def pair_terms(t: Tables) -> DataFrame:
    return counting.top_terms(t.numbers(2), 200)


def unit_terms(t: Tables) -> DataFrame:
    return counting.top_terms_per_keyword(t.words(1), 200).drop("rank")


def time_rows(t: Tables) -> DataFrame:
    return questions.time_unit(unit_terms(t))


for _factory in ("Num1Mult", "Num1Plus", "Num1concat#", "Num1mode10#", "Num1Less"):
    _name = {
        "Num1Mult": "num1_mult",
        "Num1Plus": "num1_plus",
        "Num1concat#": "num1_concat",
        "Num1mode10#": "num1_mod10",
        "Num1Less": "num1_compare",
    }[_factory]
    query(_name)(lambda t, f=_factory: questions.operand_expand(terms(t), f))
query("num2_plus")(lambda t: questions.operand_expand(pair_terms(t), "Num2Plus"))
query("num2_mult")(lambda t: questions.operand_expand(pair_terms(t), "Num2Mult"))
query("time_unit")(time_rows)
query("more_less")(lambda t: questions.operand_expand(terms(t), "Num1MoreLess"))


@query("operand_expand")
def _(t):
    parts = [questions.operand_expand(terms(t), f) for f in ("Num1#*", "Num1#+")]
    parts += [questions.operand_expand(pair_terms(t), f) for f in ("Num2#*", "Num2#+")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


query("unit_dim_join")(lambda t: questions.unit_dim_join(t.words(1)))
query("template_dim_join")(lambda t: questions.template_dim_join(questions.more_less(terms(t))))
query("digit_limit_filter")(lambda t: questions.digit_limit_filter(questions.num1_plus(t.numbers(1)), 2))


@query("question_arithmetic")
def _(t):
    x, word, y = F.col("x"), F.col("word"), F.col("y")
    return questions.num1_mult(terms(t)).select("key", questions.question_arithmetic(x, word, y).alias("question"), "z")


@query("question_comparison")
def _(t):
    x, word, y = F.col("x"), F.col("word"), F.col("y")
    return questions.more_less(terms(t)).select("key", questions.question_comparison(x, word, y).alias("question"), "z")


@query("question_time_unit")
def _(t):
    return time_rows(t).select("key", questions.question_time_unit(F.col("x"), F.col("word")).alias("question"), "z")


@query("datapoints")
def _(t):
    t.count([1], [1])
    rows = questions.num1_plus(terms(t)).unionByName(questions.more_less(terms(t))).unionByName(time_rows(t))
    return questions.datapoints(rows)


@query("question_numbers")
def _(t):
    rows = questions.datapoints(questions.more_less(terms(t)))
    numbers = questions.question_numbers(F.col("question"))
    return rows.select("question", F.array_join(numbers.cast("array<string>"), ",").alias("numbers"))


# ---------------------------------------------------------------- prompts and grading

COMPARE = ["Num1More", "Num1Less"]


def mult_points(t: Tables) -> DataFrame:
    return questions.datapoints(questions.num1_mult(terms(t)))


def compare_points(t: Tables) -> DataFrame:
    return questions.datapoints(questions.more_less(terms(t)))


def grouped_split(t: Tables, shots: int = 5):
    points = materialise(compare_points(t), "points")
    train, test = prompts.split_shots_grouped(prompts.multi_seed(points), shots, COMPARE)
    return materialise(train, "shots"), test


def mult_testcases(t: Tables) -> DataFrame:
    return prompts.testcases(mult_points(t), shots=2)


def completions(t: Tables) -> DataFrame:
    """Test cases with a completion by rule: right for some, one too high for others, and
    empty for a few."""
    x, y, seed = F.col("x").cast("int"), F.col("y").cast("int"), F.col("seed")
    lot = (x * 7 + y * 13 + seed * 5) % 100
    z = F.col("z").cast("bigint")
    given = F.when(lot < 60, F.concat(F.lit(" "), z.cast("string"), F.lit(" Q: next")))
    given = given.when(lot < 95, F.concat(F.lit(" "), (z + 1).cast("string"), F.lit(" Q: next")))
    return mult_testcases(t).withColumn("full_text", F.concat("body", given.otherwise("")))


def graded_testcases(t: Tables) -> DataFrame:
    return grading.grade_completions(completions(t)).drop("full_text")


query("multi_seed")(lambda t: prompts.multi_seed(mult_points(t)).groupBy("seed", "key").agg(n_rows()))
query("split_shots")(lambda t: prompts.split_shots(prompts.multi_seed(mult_points(t)), 8)[0])


@query("split_shots_grouped")
def _(t):
    train, test = grouped_split(t)
    sets = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return sets.select("seed", "part", "factory_type", "question", "answer")


@query("leakage_filter")
def _(t):
    train, test = grouped_split(t)
    return prompts.leakage_filter(test, train).select("seed", "factory_type", "key", "question")


@query("render_prompt")
def _(t):
    train, test = grouped_split(t)
    rows = prompts.render_prompt(prompts.leakage_filter(test, train), train, title="Answer.")
    return rows.select("seed", "factory_type", "key", "question", F.md5("body").alias("body"))


@query("grade_completions")
def _(t):
    return graded_testcases(t).select("seed", "key", "question", "answer", "generated_answer", "is_correct")


@query("flatten_results")
def _(t):
    flat = grading.flatten_results(grading.nest_results(graded_testcases(t)))
    return flat.withColumn("testcase.body", F.md5(F.col("`testcase.body`")))


query("accuracy_by_key")(lambda t: rounded(grading.accuracy_by_key(t.graded)))
query("accuracy_by_key_of_testcases")(lambda t: rounded(grading.accuracy_by_key(graded_testcases(t))))


# ---------------------------------------------------------------- lookup


for _key_type in lookup.KEY_TYPES:

    @query(f"lookup_frequency_{_key_type}")
    def _(t, key_type=_key_type):
        t.count([len(key_type)], [len(key_type)])
        return lookup.lookup_frequency(t.graded, t.frequencies.all(len(key_type)), key_type)


query("lookup_pair_frequency")(lambda t: lookup.lookup_pair_frequency(t.graded, t.numbers(2)))


@query("pair_order_check")
def _(t):
    pairs = counting.arithmetic_pattern(t.corpus).groupBy(F.col("x").alias("n1"), F.col("y").alias("n2"))
    return lookup.pair_order_check(pairs.agg(F.sum("frequency").alias("frequency")))


def looked_up(t: Tables) -> DataFrame:
    """Answers with their frequency for every key type."""
    t.count(range(1, 4), range(1, 4))
    parts = [
        lookup.lookup_frequency(t.graded, t.frequencies.all(len(names)), k).withColumn("key_type", F.lit(k))
        for k, names in lookup.KEY_TYPES.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)


query("not_found_count")(lambda t: lookup.not_found_count(looked_up(t), ["key_type", "word"]))


query("pair_digit_filter")(lambda t: lookup.pair_digit_filter(t.numbers(2), 2))
query("small_operand_filter")(lambda t: lookup.small_operand_filter(t.graded))
query("symmetry_union")(lambda t: lookup.symmetry_union(t.graded))
query("symmetry_check")(lambda t: lookup.symmetry_check(t.graded, [0, 7, 24, 50, 90, 91]))


query("drop_zero_frequency")(
    lambda t: lookup.drop_zero_frequency(looked_up(t), "lookup_frequency", ["key_type", "lookup_key"])
)


@query("drop_zero_frequency_kept")
def _(t):
    keys = ["key_type", "lookup_key"]
    kept = lookup.drop_zero_frequency(looked_up(t), "lookup_frequency", keys, drop=False)
    value = F.col("lookup_frequency")
    kind = F.when(value >= 1, "counted").when((value > 0) & (value < 1), "jitter").otherwise("zero")
    return kept.groupBy("key_type", "word", kind.alias("kind")).agg(n_rows())


query("round_key_filter")(
    lambda t: lookup.round_key_filter(t.keys).select("word", "model", "shots", "key_type", "key")
)


@query("key_parts")
def _(t):
    unit = ~F.col("word").isin(list(dims.NO_WORD_KEYS))
    parts = lookup.key_parts(F.col("key"), unit)
    rows = t.keys.select("word", "model", "shots", "key_type", "key", parts.alias("p"))
    return rows.withColumn("parts", F.array_join(F.col("p").cast("array<string>"), ",")).drop("p")


@query("important_points")
def _(t):
    rows = lookup.important_points(t.keys, [72, 71, 23, 24])
    return rounded(rows.select(*acc.CELL, "frequency", "accuracy", "label"))


# ---------------------------------------------------------------- accuracy


query("key_accuracy")(lambda t: rounded(t.keys.drop("parts")))


@query("key_accuracy_filtered")
def _(t):
    t.count([3], [3])
    rows = lookup.key_accuracy(t.graded, t.frequencies.all, "xyz", use_filter=True, make_symmetry=True)
    return rounded(rows.drop("parts", "key_type"))


@query("mean_by_frequency_key")
def _(t):
    return rounded(lookup.mean_by_frequency_key(t.graded, "key", "frequency", ["word", "model", "shots"]))


query("overall_accuracy")(lambda t: rounded(lookup.overall_accuracy(t.keys, acc.CELL)))


def listed_edges(t: Tables, q: int = 10) -> DataFrame:
    edges = acc.frequency_quantiles(t.keys, q)
    return edges.select(*acc.CELL, F.posexplode("edges").alias("place", "edge"))


query("frequency_quantiles")(lambda t: rounded(listed_edges(t)))
query("bin_accuracy")(lambda t: rounded(acc.bin_accuracy(t.keys)))
query("bin_confidence")(lambda t: rounded(acc.bin_confidence(t.keys)))
query("bin_geometry")(lambda t: rounded(acc.bin_geometry(t.keys)))
query("extrapolated_curve")(lambda t: rounded(acc.extrapolated_curve(acc.bin_table(t.keys))))
query("performance_gap")(lambda t: rounded(acc.performance_gap(acc.bin_table(t.keys))))
query("spearman_corr")(lambda t: rounded(acc.spearman_corr(t.keys)))
query("pearson_log_corr")(lambda t: rounded(acc.pearson_log_corr(t.keys)))


query("logistic_fit")(lambda t: rounded(models.logistic_fit(t.keys)))


def curve_summary(curve: DataFrame, *labels: str) -> DataFrame:
    """One row for each curve of 10,000 points: their number, range, mean and a weighted sum."""
    return curve.groupBy(*acc.CELL, *labels).agg(
        n_rows("points"),
        F.min("frequency").alias("lowest"),
        F.max("frequency").alias("highest"),
        F.avg("probability").alias("mean_probability"),
        (F.sum(F.col("probability") * (F.col("point") % 7)) / 10_000).alias("weighted"),
    )


@query("logistic_curve")
def _(t):
    return rounded(curve_summary(models.logistic_curve(models.logistic_fit(t.keys))))


@query("bayes_logistic")
def _(t):
    """Moments of the posterior, and whether the chains agree with each other and with them."""
    nodes = models.posterior_nodes(t.keys)
    known = models.posterior_moments(nodes).selectExpr(*acc.CELL, "-m0 AS beta", "sqrt(v00) AS beta_sd", "-m1 AS alpha", "sqrt(v11) AS alpha_sd")
    walked = models.chain_diagnostics(models.bayes_logistic(t.keys, nodes=nodes))
    rows = walked.withColumnsRenamed({"beta_sd": "beta_spread", "alpha_sd": "alpha_spread"}).join(known, list(acc.CELL))
    mixed = " AND ".join(f"{c}_rhat < 1.01 AND {c}_ess > 1000" for c in ("beta", "alpha"))
    near = " AND ".join(f"abs({c}_mean - {c}) < 0.1 * {c}_sd AND abs({c}_spread / {c}_sd - 1) < 0.1" for c in ("beta", "alpha"))
    truths = [F.expr(mixed).alias("mixed"), F.expr(near).alias("near")]
    return rounded(rows.select(*acc.CELL, "samples", "beta", "beta_sd", "alpha", "alpha_sd", *truths))


@query("posterior_band")
def _(t):
    """The band by quadrature, and whether the mean of the chains lies within 0.1 of it at every point.

    The ends of both bands are compared in tests only: where a posterior is split between both ends of the
    scale, 2.5 % is a cliff, and values of two estimates differ by any amount while their masses do not.
    """
    nodes = models.posterior_nodes(t.keys)
    walked = models.bayes_band(t.keys, nodes=nodes).select(*acc.CELL, "point", F.col("mean").alias("walked"))
    rows = models.quadrature_band(nodes).join(walked, [*acc.CELL, "point"])
    near = (F.abs(F.col("mean") - F.col("walked")) <= 0.1).alias("near")
    return rounded(rows.select(*acc.CELL, "point", "frequency", "mean", "low", "high", near))


def farthest_pairs(t: Tables, key_type: str, n: int = 100) -> DataFrame:
    keys = t.keys.where(F.col("key_type") == key_type)
    rows = farthest.farthest_points(keys, len(lookup.KEY_TYPES[key_type]), n)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


query("farthest_points")(lambda t: rounded(farthest_pairs(t, "xy")))
query("top_pairs")(lambda t: rounded(farthest_pairs(t, "xz")))
for _key_type in ("x", "yz", "xyz"):
    query(f"farthest_points_{_key_type}")(lambda t, k=_key_type: rounded(farthest_pairs(t, k)))


# ---------------------------------------------------------------- reports

query("gap_report_arithmetic")(lambda t: rounded(reports.gap_report_arithmetic(t.keys)))
query("gap_report_comparison")(lambda t: rounded(reports.gap_report_comparison(t.keys)))
query("gap_report_timeunit")(lambda t: rounded(reports.gap_report_timeunit(t.keys)))
query("gap_report_full")(lambda t: rounded(reports.gap_report_full(t.keys, dims.ARITHMETIC_TASKS)))
query("gap_report_percent")(lambda t: rounded(reports.gap_report_percent(t.keys, dims.ABSTRACT_TASKS)))
query("model_shot_error_bars")(lambda t: rounded(reports.model_shot_error_bars(t.keys)))
query("labels")(lambda t: reports.labels(t.graded))
query("experiment_summary")(lambda t: rounded(reports.experiment_summary(t.keys)))


@query("freq_accuracy_series")
def _(t):
    rows = reports.freq_accuracy_series(t.keys)
    total = lambda c: F.sum(F.col(c) * (F.length("point") % 5 + 1)).alias(c)
    return rounded(rows.groupBy(*acc.CELL, "series").agg(n_rows(), total("value"), total("low"), total("high")), 3)


for _by in ("shots", "models", "both"):

    @query(f"logistic_series_by_{_by}")
    def _(t, by=_by):
        return rounded(curve_summary(reports.logistic_series_by(t.keys, by), "label"))

    @query(f"interpolation_series_by_{_by}")
    def _(t, by=_by):
        return rounded(reports.interpolation_series_by(t.keys, by))


# ---------------------------------------------------------------- from corpus to report

EXPERIMENTS = {"mult": "Num1Mult", "plus": "Num1Plus"}


def experiment_answers(t: Tables) -> DataFrame:
    """Graded answers of whole experiments: top terms, questions, seeds, shots, leakage filter,
    prompts, completions by rule for three models, grades."""
    parts = []
    for word, factory in EXPERIMENTS.items():
        points = questions.datapoints(questions.operand_expand(terms(t), factory))
        for shots in (2, 8):
            cases = prompts.testcases(points, shots=shots)
            parts.append(cases.select("*", F.lit(shots).alias("shots"), F.lit(word).alias("experiment")))
    rows = functools.reduce(DataFrame.unionByName, parts)
    rows = rows.withColumn("model", F.explode(F.array(*[F.lit(m) for m in derived.MODELS])))
    x, y, z = (F.col(c).cast("bigint") for c in ("x", "y", "z"))
    lot = (x * 7 + y * 13 + F.col("seed") * 5 + F.col("shots") * 3 + F.length("model") * 11) % 100
    known = lot < 30 + F.col("shots") * 2 + F.length(F.col("frequency").cast("string")) * 5
    given = F.concat(F.lit(" "), F.when(known, z).otherwise(z + 1).cast("string"), F.lit(" Q: next"))
    graded = grading.grade_completions(rows.withColumn("full_text", F.concat("body", given)))
    return graded.select("seed", "shots", "model", F.col("experiment").alias("word"), x.alias("x"), y.alias("y"), z.alias("z"), "is_correct")


@query("experiment_report")
def _(t):
    t.count([1, 2], [1, 2])
    answers = materialise(experiment_answers(t), "experiment-answers")
    keys = [lookup.key_accuracy(answers, t.frequencies.all, k) for k in ("x", "xy", "xz")]
    keys = materialise(functools.reduce(DataFrame.unionByName, keys), "experiment-keys")
    return rounded(reports.gap_report_full(keys, dims.ARITHMETIC_TASKS))
