"""Counting a corpus that grows: each micro-batch writes its counts, reading merges them.

Keys have no time, so there is no watermark to expire them by. Partial counts therefore go to
files and not to the state store. A batch writes to a folder of its own id and replaces what an
earlier attempt left there, so a retried batch is counted once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from termgauge.operators import counting


def incremental_counts(
    corpus: DataFrame,
    path: str,
    checkpoint: str,
    count: Callable[[DataFrame], DataFrame] = counting.num_co_occurrence,
) -> StreamingQuery:
    """Count what has arrived of a streaming ``corpus`` and stop; run again for new files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        corpus.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_incremental_counts(spark: SparkSession, path: str) -> DataFrame:
    """The merged counts of all batches."""
    parts = spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    return counting.merge_counts(parts)
