"""Connected components of an edge table, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgauge.session import discard, written

ROUNDS = 100


def _key(edges: DataFrame) -> tuple:
    one = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(one)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """id, root for every id of ``edges`` (a, b): root is the smallest id that links reach.

    Each round joins every edge with the smallest neighbour of its larger end, then of its
    smaller end. The minima are partial sums, and the joins have one row for each id on one side,
    so Spark splits the partitions of an id with many edges. Every round is written to the shared
    folder; what goes over the driver is a count and a checksum.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, path = written(e, label)
    seen = _key(e)
    for _ in range(ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        # An id always keeps an edge to its smallest neighbour, so no link is lost.
        large = large.unionByName(own).where("a <> b").distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(first.select("a", F.col("m").alias("b"))).where("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        e, fresh = written(small, label)
        now = _key(e)
        discard(edges.sparkSession, path)
        path = fresh
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
    return roots.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
