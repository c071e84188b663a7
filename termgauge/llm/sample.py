"""A bounded sample of labelled texts, taken without moving the other texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_texts(
    documents: DataFrame,
    labels: DataFrame,
    label: str,
    at_most: Mapping[int, int],
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """label, n, text of at most ``at_most[label]`` documents of each label, those with the smallest hash of the key.

    The keys are chosen from the labels alone and broadcast: at most the sum of ``at_most`` rows. Hashes are
    even, so those below about ``2 * most + 50`` times the mean distance of a label's hashes hold its ``most``
    smallest, and only they are ranked, however many labels there are.
    A key that several rows share counts once, with its largest label and its smallest text.
    """
    known = labels.where(F.col(f"`{label}`").isin(*at_most) & F.col(f"`{key}`").isNotNull())
    known = known.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max(F.col(f"`{label}`")).cast("int").alias("label"))
    limit = F.lit(0)
    for value, most in at_most.items():
        limit = F.when(F.col("label") == value, most).otherwise(limit)
    # One row for each label asked for.
    share = known.groupBy("label").agg(((2 * F.first(limit) + 50) / F.count(F.lit(1))).alias("share"))
    place = F.xxhash64("_key") / F.lit(2.0**64) + 0.5  # of the key's hash among all hashes
    low = known.join(F.broadcast(share), "label").where(place <= F.col("share"))
    first = Window.partitionBy("label").orderBy(F.xxhash64("_key"), "_key")
    chosen = low.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit).select("_key", "label", "n")
    texts = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(chosen), "_key").groupBy("label", "n").agg(F.min("text").alias("text"))
