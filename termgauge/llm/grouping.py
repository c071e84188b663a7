"""Groups of rows for Arrow functions, and the splitting of large groups into pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``n_keys`` columns; the rows must come sorted by them."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        lo = 0
        for at in range(len(keys)):
            if last is not None and keys[at] != last:
                if at > lo:
                    kept.append(batch.slice(lo, at - lo))
                yield pa.Table.from_batches(kept)
                kept, lo = [], at
            last = keys[at]
        kept.append(batch.slice(lo))
    if kept:
        yield pa.Table.from_batches(kept)


def block_pairs(rows: DataFrame, size: int, ratio: float) -> DataFrame:
    """``rows`` (key, n, id, ...) with pair and side, so that rows that may match share a pair.

    Rows of a key match only if the smaller ``n`` is at least ``ratio`` of the larger. A key of at
    most ``size`` rows is one pair by itself. A larger one is cut into bands of ``n``, each band
    by a hash of ``id`` into blocks of about ``size`` rows; every two blocks of the same or of
    neighbouring bands make a pair, and a row goes to all pairs of its block. Only counts of keys
    and bands are grouped. side is 0 or 1, and 2 in a pair of a block with itself.
    """
    band = F.floor(F.log("n") / F.lit(1.0001) / F.log(F.lit(1 / ratio)))
    rows = rows.withColumn("band", band)
    cells = rows.groupBy("key", "band").agg(F.count(F.lit(1)).alias("rows"))
    totals = cells.groupBy("key").agg(F.sum("rows").alias("total"))
    parts = cells.join(totals, "key").withColumn(
        "parts", F.when(F.col("total") <= size, 0).otherwise(F.ceil(F.col("rows") / size))
    )
    large = parts.where("parts > 0").select("key", "band", "parts")
    placed = rows.join(parts.select("key", "band", "parts"), ["key", "band"])
    one = placed.where("parts = 0").select(
        *rows.drop("band").columns, F.lit(0).cast("bigint").alias("pair"), F.lit(2).alias("side")
    )
    block = large.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    left = block.select("key", F.col("band").alias("b1"), F.col("part").alias("p1"))
    right = block.select("key", F.col("band").alias("b2"), F.col("part").alias("p2"))
    near = (F.col("b2") == F.col("b1") + 1) | ((F.col("b2") == F.col("b1")) & (F.col("p2") >= F.col("p1")))
    pairs = left.join(right, "key").where(near).withColumn("pair", F.xxhash64("b1", "p1", "b2", "p2"))
    same = (F.col("b1") == F.col("b2")) & (F.col("p1") == F.col("p2"))
    first = pairs.select("key", F.col("b1").alias("band"), F.col("p1").alias("part"), "pair", F.when(same, 2).otherwise(0).alias("side"))
    second = pairs.where(~same).select("key", F.col("b2").alias("band"), F.col("p2").alias("part"), "pair", F.lit(1).alias("side"))
    many = placed.where("parts > 0").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    many = many.join(first.unionByName(second), ["key", "band", "part"])
    return one.unionByName(many.select(one.columns))
