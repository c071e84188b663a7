"""Left join of rows to a unique lookup table when single keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgauge.session import materialise


def hot_keys(rows: DataFrame, keys: list[str], share: float = 0.001) -> DataFrame:
    """Keys with more than ``share`` of all rows: at most ``1 / share`` of them."""
    total = rows.agg(F.count(F.lit(1)))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counted.where(F.col("_rows") > total.scalar() * share).select(*keys)


def left_lookup(rows: DataFrame, table: DataFrame, keys: list[str], share: float = 0.001) -> DataFrame:
    """``rows`` LEFT JOIN ``table`` on ``keys``, where ``table`` has one row per key.

    Rows of hot keys never move: their part of the table, at most ``1 / share`` rows, is
    written once and broadcast. The other rows are shuffled, and no key among them is heavy.
    Key columns must not be NULL.
    """
    hot = materialise(hot_keys(rows, keys, share), "hot-keys")
    hot_table = materialise(hot.join(table.join(F.broadcast(hot), keys, "left_semi"), keys, "left"), "hot-rows")
    hot_rows = rows.join(F.broadcast(hot_table), keys)
    other_rows = rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, "left")
    return hot_rows.unionByName(other_rows)


FEW_KEYS = 200_000  # asked for, that are broadcast


def asked_part(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``table`` whose keys the rows ask for, written once. The table moves only if the rows ask for
    more than ``FEW_KEYS`` keys."""
    asked = materialise(rows.select(*keys).distinct(), "asked-keys")
    few = asked.count() <= FEW_KEYS
    return materialise(table.join(F.broadcast(asked) if few else asked, keys, "left_semi"), "asked-rows")


def asked_lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``left_lookup`` in a table of which the rows ask for a small part; rows move only if that part holds more
    than ``FEW_KEYS`` keys."""
    found = asked_part(rows, table, keys)
    if found.count() <= FEW_KEYS:
        return rows.join(F.broadcast(found), keys, "left")
    return left_lookup(rows, found, keys)
