"""Reading corpora, windows, count tables and result files.

Paths go to Spark's file systems as they are, so globs, local paths and object stores all work.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termgauge.functions import dimensions as dims
from termgauge.operators.counting import top_terms
from termgauge.operators.grading import RESULT_COLUMNS

CORPUS_SCHEMA = "text string, meta string"
WINDOW_SCHEMA = "meta string, text string, middle string"


def _read(spark: SparkSession, path, schema: str, format: str) -> DataFrame:
    if format == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if format != "json":
        raise ValueError(f"unknown format {format!r}; known: parquet, json")
    # A line that is no JSON of this schema stops the job; blank lines are skipped.
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_corpus(spark: SparkSession, path: str | Sequence[str], format: str = "json") -> DataFrame:
    """JSON lines with ``text`` and ``meta`` (kept as JSON text), or Parquet."""
    return _read(spark, path, CORPUS_SCHEMA, format)


def read_windows(spark: SparkSession, path: str | Sequence[str], format: str = "json") -> DataFrame:
    """Number windows: JSON lines with ``meta, text, middle``, or Parquet."""
    return _read(spark, path, WINDOW_SCHEMA, format)


def parse_count_lines(lines: DataFrame, numbers: int, keyword: bool = False) -> DataFrame:
    """Count tuples printed one per line in column ``value``, such as ``('24', 123)`` or
    ``(('5', 'minute'), 9)``, as ``n1..nk[, keyword], frequency``.

    The parts may stand in single or double quotes. Blank lines are skipped; any other line that
    is not a tuple of this shape is an error.
    """
    names = [f"n{i + 1}" for i in range(numbers)] + (["keyword"] if keyword else [])
    part = r"""(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")"""
    listed = r"\(\s*" + r"\s*,\s*".join([part] * len(names)) + r"\s*,?\s*\)" if len(names) > 1 else part
    pattern = rf"^\s*\(\s*{listed}\s*,\s*(\d+)\s*\)\s*$"
    value = F.col("value")
    bad = F.raise_error(F.concat(F.lit("not a count: "), value))
    rows = lines.where(~value.rlike(r"^\s*$")).select(F.when(value.rlike(pattern), value).otherwise(bad.cast("string")).alias("value"))
    group = lambda i: F.regexp_extract("value", pattern, i)
    return rows.select(
        *[F.concat(group(2 * i + 1), group(2 * i + 2)).alias(n) for i, n in enumerate(names)],
        group(2 * len(names) + 1).cast("bigint").alias("frequency"),
    )


def read_counts(
    spark: SparkSession,
    path: str | Sequence[str],
    numbers: int = 1,
    keyword: bool = False,
    format: str = "parquet",
) -> DataFrame:
    """A count table from Parquet, or from part files of printed tuples (``format="text"``)."""
    if format == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if format != "text":
        raise ValueError(f"unknown format {format!r}; known: parquet, text")
    return parse_count_lines(spark.read.text(path), numbers, keyword)


def read_frequency(
    spark: SparkSession,
    path: str,
    top: int = 200,
    numbers: int = 1,
    keyword: bool = False,
    format: str = "parquet",
) -> DataFrame:
    """The ``top`` most frequent keys of a count table."""
    return top_terms(read_counts(spark, path, numbers, keyword, format), top)


def constant_frequency(spark: SparkSession, low: int = 0, high: int = 99, frequency: int = 100) -> DataFrame:
    """Keys ``low`` to ``high``, all with the same frequency."""
    return spark.range(low, high + 1).select(
        F.col("id").cast("string").alias("n1"), F.lit(frequency).cast("bigint").alias("frequency")
    )


def read_results(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Graded answers from CSV files with dotted column names: flat names, is_correct as 0/1,
    operands and frequency as numbers. Columns beyond the known ones are kept as strings.

    A number or truth value that cannot be read is an error, and so are a broken record and files with
    different headers. Fields may hold line feeds; files are split nevertheless (``csv_records``).
    """
    names = spark.read.csv(path, header=True, quote='"', escape='"').columns
    options = {"quote": '"', "escape": '"', "mode": "FAILFAST"}
    values = F.from_csv("record", ", ".join(f"`{n}` string" for n in names), options)
    rows = csv_records(spark, path).withColumn("row", values)
    same = F.array(*[F.coalesce(F.col(f"row.`{n}`"), F.lit("")) for n in names]) == F.array(*[F.lit("" if n.startswith("_c") else n) for n in names])
    bad = F.raise_error(F.concat(F.lit("another header: "), F.col("record"))).cast("boolean")
    raw = rows.where(~F.when(F.col("first"), F.when(same, True).otherwise(bad)).otherwise(False)).select("row.*")
    known = {dotted: flat for dotted, flat in RESULT_COLUMNS.items() if dotted in raw.columns}
    numeric = {"x": "bigint", "y": "bigint", "z": "bigint", "frequency": "bigint"}
    others = [c for c in raw.columns if c not in known and not c.startswith("_c") and c != "Unnamed: 0"]
    columns = []
    for dotted, flat in known.items():
        value = F.col(f"`{dotted}`")
        if flat == "is_correct":
            bad = F.raise_error(F.concat(F.lit(f"{dotted} is no truth value: "), value)).cast("boolean")
            truth = value.try_cast("boolean")
            value = F.when(value.isNotNull() & truth.isNull(), bad).otherwise(truth).cast("int")
        elif flat in numeric:
            bad = F.raise_error(F.concat(F.lit(f"{dotted} is no number: "), value)).cast(numeric[flat])
            number = value.try_cast(numeric[flat])
            value = F.when(value.isNotNull() & number.isNull(), bad).otherwise(number)
        columns.append(value.alias(flat))
    return raw.select(*[F.col(f"`{c}`") for c in others], *columns)


# ---------------------------------------------------------------- CSV records over splits

LARGEST = 1_000_000  # splits whose parities are sent to every task: a name, a number and a bit for each


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The records of CSV files whose fields may hold line feeds: ``record`` (without its end of line) and
    ``first`` (of its file). Files are read in splits like any text.

    A line feed ends a record unless an odd number of quotes precedes it in the file. Pass one counts the
    quotes of every split; their running parity over a file tells each split whether it begins within a
    field. Pass two puts the lines of each split together. What is left of a record at the edges of splits, two
    pieces of each at most, is joined by the split that the record began in.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = lines.select(*place, "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.coalesce(F.sum("odd").over(order), F.lit(0)) % 2) == 1
    splits = counted.select("file", "start", inside.alias("inside"), ((inside.cast("int") + F.col("odd")) % 2 == 1).alias("open"))
    found = splits.limit(LARGEST + 1).collect()
    if len(found) > LARGEST:
        raise ValueError(f"more than {LARGEST} splits; raise spark.sql.files.maxPartitionBytes")
    last = {r.file: r for r in sorted(found, key=lambda r: r.start)}
    if unclosed := [r.file for r in last.values() if r.open]:
        raise ValueError(f"a quote is never closed: {unclosed[0]}")
    begins = spark.sparkContext.broadcast({(r.file, r.start): r.inside for r in found})
    rows = lines.mapInArrow(_records_of(begins), "record string, first boolean, file string, start bigint, kind int")
    edges = rows.where(F.col("kind") != WHOLE)
    before = Window.partitionBy("file").orderBy("start", "kind")
    edges = edges.withColumn("owner", F.last(F.when(F.col("kind") == BEGUN, F.col("start")), ignorenulls=True).over(before))
    pieces = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    joined = edges.groupBy("file", "owner").agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"), F.bool_or("first").alias("first"))
    whole = rows.where(F.col("kind") == WHOLE).select("record", "first").unionByName(joined.select("record", "first"))
    return whole.select(F.regexp_replace("record", "\r$", "").alias("record"), "first").where("record <> ''")


WHOLE, ENDED, BEGUN = 0, 1, 2  # records within a split; the rest of one begun before; one that goes on after


def _records_of(begins):
    """Lines (file, start of the split, value) in the order of their splits as records and pieces of records."""

    def run(batches):
        at, inside, head, buffer, number = None, False, False, [], 0
        for batch in batches:
            files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            values = batch.column(2).to_pylist()
            out = []
            for file, start, value in zip(files, starts, values):
                if at != (file, start):
                    if buffer:
                        out.append(("\n".join(buffer), number == len(buffer) and at[1] == 0, *at, ENDED if head else BEGUN))
                    at, buffer, number = (file, start), [], 0
                    inside = head = begins.value[at]
                buffer.append(value)
                number += 1
                inside ^= value.count('"') & 1 == 1
                if not inside:
                    first = number == len(buffer) and start == 0
                    out.append(("\n".join(buffer) if len(buffer) > 1 else value, first, file, start, ENDED if head else WHOLE))
                    head, buffer = False, []
            yield _record_batch(out)
        if buffer:
            yield _record_batch([("\n".join(buffer), number == len(buffer) and at[1] == 0, *at, ENDED if head else BEGUN)])

    return run


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("record", pa.string()), ("first", pa.bool_()), ("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32())]
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [n for n, _ in kinds])


class FrequencyTables:
    """Number and number-keyword count tables by number of key parts, opened once each."""

    def __init__(self, numbers, words):
        """``numbers`` and ``words`` map a number of key parts to a count table."""
        self._sources = {"numbers": numbers, "words": words}
        self._open: dict[tuple[str, int], DataFrame] = {}

    def _table(self, kind: str, num_count: int) -> DataFrame:
        key = (kind, num_count)
        if key not in self._open:
            self._open[key] = self._sources[kind](num_count)
        return self._open[key]

    def frequency_for(self, word: str, num_count: int = 1) -> DataFrame:
        """Counts to look up for an experiment word: ``n1..nk, keyword, frequency``. Words
        without a unit use the number counts with an empty keyword."""
        if word in dims.NO_WORD_KEYS:
            return self._table("numbers", num_count).withColumn("keyword", F.lit(""))
        return self._table("words", num_count).where(F.col("keyword") == word)

    def all(self, num_count: int = 1) -> DataFrame:
        """The tables of all experiment words in one."""
        plain = self._table("numbers", num_count).withColumn("keyword", F.lit(""))
        return plain.unionByName(self._table("words", num_count))
