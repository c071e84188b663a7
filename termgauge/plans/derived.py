"""Inputs derived from the given tables, row by row.

``documents`` holds no numbers, so the corpus is written from the rows of ``lineitem`` (short
texts) and from ``documents`` with its short words turned into numbers and keywords (long
texts). Graded answers are derived from ``lineitem`` in the same way. No step groups rows, so
a hot order, part or source costs nothing. The SQL strings serve Spark and DuckDB alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from termgauge.operators import counting, lookup
from termgauge.sources.readers import FrequencyTables
from termgauge.session import materialise

# ---------------------------------------------------------------- corpus

LINE_FIELDS = {
    "q": "CAST(l_quantity AS INT)",
    "n": "l_linenumber",
    "s": "l_suppkey",
    "m": "l_partkey % 100",
}
LINE_COLUMNS = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity"
LINE_ID = "l_orderkey * 8 + l_linenumber"
LINE_META = "concat('{\"source\":\"lineitem\",\"part\":', CAST(p AS VARCHAR(20)), '}')"
LINE_TEXT = """concat_ws(' ',
  CASE p % 5
    WHEN 0 THEN concat_ws(' ', q, 'times', n, 'is', q * n)
    WHEN 1 THEN concat_ws(' ', q, '+', n, '=', q + n)
    WHEN 2 THEN concat_ws(' ', q, 'minutes', 'and', n, 'seconds')
    WHEN 3 THEN concat_ws(' ', 'after', n, 'Hours', 'or', q, 'days')
    ELSE concat_ws(' ', q, 'years') END,
  CASE s % 4
    WHEN 0 THEN concat_ws(' ', s, '-', n, 'minus', m)
    WHEN 1 THEN concat_ws(' ', 'of', m, 'months', s, q)
    WHEN 2 THEN concat_ws(' ', m, '*', s, '=', m * s)
    ELSE concat_ws(' ', 'about', concat('0', CAST(n AS VARCHAR(2))), 'decades', 'x', m) END)"""

# A word of up to three small letters becomes a number, some frequent words become keywords.
WORD_RULE = """CASE word
    WHEN 'the' THEN 'times' WHEN 'of' THEN 'Minutes' WHEN 'and' THEN 'plus' WHEN 'la' THEN '+'
    WHEN 'der' THEN 'days' WHEN 'de' THEN '*' WHEN 'that' THEN 'YEARS' WHEN 'was' THEN 'decade'
    ELSE CASE WHEN length(word) <= 3 AND word = lower(word) AND translate(word, 'abcdefghijklmnopqrstuvwxyz', '') = ''
      THEN translate(word, 'abcdefghijklmnopqrstuvwxyz', '01234567890123456789012345') ELSE word END END"""


def write_lines(lineitem: DataFrame) -> DataFrame:
    """One short text per line item: ``doc_id, text, meta``."""
    fields = [f"{e} AS {c}" for c, e in LINE_FIELDS.items()]
    rows = lineitem.selectExpr(f"{LINE_ID} AS doc_id", "l_partkey AS p", *fields)
    return rows.selectExpr("doc_id", f"{LINE_TEXT} AS text", f"{LINE_META} AS meta")


def line_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_lines(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


# The same rule for the distinct words of a batch.
KEYWORD_OF = {
    "the": "times", "of": "Minutes", "and": "plus", "la": "+", "der": "days", "de": "*", "that": "YEARS", "was": "decade"
}
DIGIT_OF = str.maketrans("abcdefghijklmnopqrstuvwxyz", "01234567890123456789012345")
SHORT_WORD = re.compile("[a-z]{1,3}")
GAPS = pa.array(["\n" if i == 0 else "\u00a0" if i == 8 else " " for i in range(16)], pa.large_string())
TEXTS_AT_ONCE = 500


def ruled(word: str) -> str:
    """``WORD_RULE`` of one word."""
    return KEYWORD_OF.get(word) or (word.translate(DIGIT_OF) if SHORT_WORD.fullmatch(word) else word)


def _written(texts: pa.Array) -> pa.Array:
    """Texts with the rule applied to each token and a gap before it; every distinct token is looked at once."""
    texts = texts.cast(pa.large_string())
    cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    ends, blank = cut.offsets.to_numpy(), pc.equal(pc.utf8_trim_whitespace(texts), "").fill_null(True).to_numpy(zero_copy_only=False)
    # A blank text is cut into one empty token, which is none.
    lengths = np.where(blank, 0, np.diff(ends))
    tokens = cut.flatten().filter(pa.array(np.repeat(~blank, np.diff(ends))))
    coded = pc.dictionary_encode(tokens)
    words = pa.array([ruled(w) for w in coded.dictionary.to_pylist()], pa.large_string()).take(coded.indices)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(tokens)) - np.repeat(first, lengths)
    joined = pc.binary_join_element_wise(GAPS.take(pa.array(place % len(GAPS))), words, pa.scalar("", pa.large_string()))
    at = pa.array(np.append(first, len(tokens)), pa.int32())
    whole = pc.binary_join(pa.ListArray.from_arrays(at, joined.cast(pa.string())), "")
    return pc.if_else(texts.is_valid(), whole, pa.scalar(None, pa.string()))


def write_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with numbers and keywords: ``doc_id, text, meta``.

    Every 16th gap is a line feed, and every 16th from the ninth a no-break space.
    """
    docs = documents.select("doc_id", "text", "lang", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(start, TEXTS_AT_ONCE)
                yield batch.set_column(1, "text", _written(batch.column(1)))

    meta = "concat('{\"lang\":\"', lang, '\",\"source\":\"', source, '\"}') AS meta"
    return docs.mapInArrow(run, docs.schema).selectExpr("-1 - doc_id AS doc_id", "text", meta)


def document_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# ---------------------------------------------------------------- graded answers

# Experiment words and models, as used in the names of result files.
WORDS = (
    "mult plus concat plushashtag multhashtag mode10hashtag compareless comparemore comparemoreless "
    "minute hour day week month year decade"
).split()
MODELS = ("gptjsmall", "gptjlarge", "gptj")
SHOTS = (0, 2, 4, 8, 16)


def _case(index: str, values) -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


GRADED_STEPS = (
    # experiment cell and operands
    {
        "seed": "l_linenumber % 5",
        "shots": "CAST(" + _case("l_partkey % 5", SHOTS) + " AS INT)",
        "model": _case("l_suppkey % 3", MODELS),
        "word": _case("l_orderkey % 16", WORDS),
        "x": "CAST(CAST(l_quantity AS INT) + CASE WHEN l_partkey % 3 = 0 THEN 49 ELSE 0 END AS BIGINT)",
        "b": "CAST((l_suppkey * 7 + l_linenumber) % 100 AS BIGINT)",
        "n": "l_linenumber",
    },
    {
        "y": "CASE word WHEN 'minute' THEN 60 WHEN 'hour' THEN 60 WHEN 'day' THEN 24 WHEN 'week' THEN 7"
        " WHEN 'month' THEN 4 WHEN 'year' THEN 12 WHEN 'decade' THEN 10 WHEN 'mode10hashtag' THEN 10 ELSE b END",
    },
    {
        "z": "CASE WHEN word IN ('plus', 'plushashtag') THEN x + y"
        " WHEN word = 'concat' THEN CASE WHEN y < 10 THEN x * 10 + y ELSE x * 100 + y END"
        " WHEN word = 'compareless' OR (word = 'comparemoreless' AND n % 2 = 0) THEN least(x, y)"
        " WHEN word IN ('comparemore', 'comparemoreless') THEN greatest(x, y)"
        " WHEN word = 'mode10hashtag' THEN x % 10"
        " ELSE x * y END",
        "key": "CAST(x AS VARCHAR(20))",
        "frequency": "CAST(floor(100000.0 / (x + 1)) AS BIGINT)",
        "is_correct": "CASE WHEN (x * 7 + y * 13 + seed * 5 + shots * 3 + length(model) * 11) % 100"
        " < least(95, 20 + shots * 2 + length(word) + floor((99 - x) / 2.0)) THEN 1 ELSE 0 END",
    },
)
GRADED_COLUMNS = "seed shots model word key frequency x y z is_correct".split()


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graded answer per line item: ``seed, shots, model, word, key, frequency, x, y, z,
    is_correct``."""
    return grade(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def grade(lineitem: DataFrame) -> DataFrame:
    rows = lineitem
    for i, step in enumerate(GRADED_STEPS):
        kept = [] if i == 0 else ["*"]
        rows = rows.selectExpr(*kept, *[f"{e} AS {c}" for c, e in step.items()])
    return rows.select(*GRADED_COLUMNS)


# ---------------------------------------------------------------- written tables


class Tables:
    """Derived tables of one data folder, written once per application and then shared."""

    _open: dict[tuple[str, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._written: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        key = (spark.sparkContext.applicationId, str(sf_dir).rstrip("/"))
        if key not in cls._open:
            cls._open[key] = cls(spark, key[1])
        return cls._open[key]

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._written:
            self._written[name] = materialise(build(), name)
        return self._written[name]

    def _dealt(self, name: str, columns: str) -> DataFrame:
        """Columns of a given table over as many tasks as the session has shuffle partitions, however its file is
        cut. They are dealt before texts are written from them, since the given rows are smaller, and by a hash of the
        whole row, since Spark sorts rows that it deals in turn."""
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").select(*columns.split())
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *rows.columns)

    def _by_supplier(self) -> DataFrame:
        """Line items dealt by ranges, so that the texts that name a supplier are next to each other and a block of them
        holds fewer different tuples. The other keys divide the lines of a hot supplier; within a task their order does
        not matter, and Spark sorts by one integer several times faster."""
        rows = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet").select(*LINE_COLUMNS.split())
        along = ["l_suppkey", "l_partkey", "l_orderkey", "l_linenumber"]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionByRange(parts, *along).sortWithinPartitions("l_suppkey")

    @property
    def lines(self) -> DataFrame:
        return self._once("lines", lambda: write_lines(self._by_supplier()))

    @property
    def documents(self) -> DataFrame:
        return self._once("documents", lambda: write_documents(self._dealt("documents", "doc_id text lang source")))

    @property
    def corpus(self) -> DataFrame:
        """Texts of both kinds. They are not written for a single pass; what was written before is read."""
        lines = self._written["lines"] if "lines" in self._written else write_lines(self._by_supplier())
        documents = self._written["documents"] if "documents" in self._written else write_documents(self._dealt("documents", "doc_id text lang source"))
        return lines.unionByName(documents)

    @property
    def graded(self) -> DataFrame:
        return self._once("graded", lambda: grade(self._dealt("lineitem", LINE_COLUMNS)))

    @property
    def passing_graded(self) -> DataFrame:
        """Graded answers for a single pass, which are not written for it."""
        return self._written["graded"] if "graded" in self._written else grade(self._dealt("lineitem", LINE_COLUMNS))

    def count(self, numbers: Sequence[int], words: Sequence[int]) -> None:
        """Counts of numbers and words of the given sizes in one pass, as far as they are not there yet."""
        numbers = [k for k in numbers if f"numbers{k}" not in self._written]
        words = [k for k in words if f"words{k}" not in self._written]
        if numbers or words:
            plain, keyed = counting.frequency_counts(self.corpus, numbers, words)
            self._written |= {f"numbers{k}": t for k, t in plain.items()} | {f"words{k}": t for k, t in keyed.items()}

    def numbers(self, num_count: int) -> DataFrame:
        """Counts of number k-tuples: ``n1..nk, frequency``."""
        self.count([num_count], [])
        return self._written[f"numbers{num_count}"]

    def words(self, num_count: int) -> DataFrame:
        """Counts of number k-tuples with a keyword: ``n1..nk, keyword, frequency``."""
        self.count([], [num_count])
        return self._written[f"words{num_count}"]

    @property
    def frequencies(self) -> FrequencyTables:
        return FrequencyTables(self.numbers, self.words)

    @property
    def keys(self) -> DataFrame:
        """``key_accuracy`` of all graded answers for all key types."""

        def build() -> DataFrame:
            sizes = range(1, 4)
            sums = materialise(lookup.operand_sums(self.passing_graded), "operand-sums")  # read once per key type
            self.count(sizes, sizes)
            parts = [lookup.key_accuracy(sums, self.frequencies.all, k) for k in lookup.KEY_TYPES]
            rows = parts[0]
            for part in parts[1:]:
                rows = rows.unionByName(part)
            return rows

        return self._once("keys", build)
