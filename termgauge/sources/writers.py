"""Writing windows, count tables and results. Nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgauge.functions import dimensions as dims
from termgauge.operators.counting import key_columns, sort_by_frequency


def write_windows(windows: DataFrame, path: str, max_lines: int = 10_000_000, mode: str = "errorifexists") -> None:
    """JSON lines in files of at most ``max_lines`` lines."""
    writer = windows.write.mode(mode).option("maxRecordsPerFile", max_lines)
    writer.option("ignoreNullFields", False).json(path)


def write_counts(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    counts.write.mode(mode).parquet(path)


def count_line(counts: DataFrame) -> Column:
    """A count as a printed tuple: ``('24', 123)``, ``(('12', '7'), 45)``."""
    quoted = [F.concat(F.lit("'"), F.col(c), F.lit("'")) for c in key_columns(counts)]
    key = quoted[0] if len(quoted) == 1 else F.concat(F.lit("("), F.concat_ws(", ", *quoted), F.lit(")"))
    return F.concat(F.lit("("), key, F.lit(", "), F.col("frequency").cast("string"), F.lit(")"))


def write_count_lines(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Part files of printed tuples, one per line."""
    counts.select(count_line(counts).alias("value")).write.mode(mode).text(path)


def write_sorted_counts(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Part files that hold the counts in falling order when read in the order of their names."""
    sort_by_frequency(counts).write.mode(mode).parquet(path)


def keyword_file(keyword: Column) -> Column:
    """Folder name for a keyword: signs are spelt out."""
    return dims.lookup(keyword, dims.KEYWORD_FILES, keyword)


def write_counts_by_keyword(counts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder ``keyword_file=<name>`` per keyword, each in falling order over its files.

    The ranges include the frequency, so a frequent keyword is spread over several tasks.
    """
    keys = [c for c in key_columns(counts) if c != "keyword"]
    order = ["keyword_file", F.desc("frequency"), *keys]
    rows = counts.withColumn("keyword_file", keyword_file(F.col("keyword")))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy(
        "keyword_file"
    ).parquet(path)


def write_results(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Result rows as CSV with a header; ``mode`` is overwrite, append or errorifexists."""
    results.write.mode(mode).option("escape", '"').csv(path, header=True)


def agg_path(path: str) -> str:
    """``results.csv`` -> ``results.agg.csv``."""
    parts = path.split(".")
    return ".".join([*parts[:-1], "agg", parts[-1]])


def write_accuracy_by_key(accuracy: DataFrame, results_path: str, mode: str = "append") -> str:
    """The accuracy table next to the results, under ``agg_path``; returns that path."""
    target = agg_path(results_path)
    accuracy.write.mode(mode).csv(target, header=True)
    return target


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report table (one row per experiment) as one CSV file."""
    report.coalesce(1).write.mode(mode).csv(path, header=True)
