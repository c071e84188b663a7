"""Pairs of close keys that differ most in frequency and accuracy.

The score of a pair is ``(f_i - f_j)^3 (a_i - a_j) / (product of key gaps)^2``, where the gap of
two equal key numbers is 0.01. Only the best pairs of a cell are wanted, so the keys of a cell form a
k-d tree and pairs of its nodes are traversed from the root down:

1. The most frequent keys of a cell, and the first ones as printed, meet all its keys. The ``n``-th best
   of these pairs is a threshold that every pair of the result reaches.
2. Every key has a place in the cell's box of key numbers, frequency and accuracy, halved in turn along
   each of them; a node is a prefix of that code, with the smallest box around its keys. A pair of nodes is
   dropped when no pair of their keys can reach the threshold: the numerator is bilinear in its two factors,
   so its largest value stands in a corner, and the gaps of two boxes lie between two products. Pairs that
   tie with the threshold are told apart by their keys, so a cell of equal accuracies (all scores zero)
   or of falling ones (all scores negative) is pruned like any other.
3. Pairs of nodes with few pairs of keys are opened, the others go on to their children, and the threshold
   rises with every round. The result is exact.

Scorers of the caller's bring a bound along (``bound``); without one, cells of more than ``UNBOUNDED`` keys
are refused, since nothing but all pairs could answer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgauge.operators.accuracy import CELL
from termgauge.operators.lookup import is_round_key
from termgauge.session import discard, written

EQUAL_GAP = 0.01  # fixed value
SEEDS = 16  # keys of a cell, most frequent and first ones, that give the first threshold
SALT = 8  # parts of a cell that meet its seeds in different tasks
STEP = 4  # bits of the code from a node to its children
BITS = 60  # of the code, shared by all axes
OPENED = 256  # pairs of keys that a pair of nodes is opened for
EAGER = 200_000  # pairs of keys left, of all cells, that are opened without another round
UNBOUNDED = 2000  # keys of a cell that all pairs are compared of


def _gap(i: Column, j: Column) -> Column:
    return F.when(i == j, F.lit(EQUAL_GAP)).otherwise(F.abs(i - j).cast("double"))


def index_score(i: Column, j: Column, size: int) -> Column:
    """Squared product of the gaps of two keys given as arrays of numbers."""
    product = _gap(F.get(i, F.lit(0)), F.get(j, F.lit(0)))
    for c in range(1, size):
        product = product * _gap(F.get(i, F.lit(c)), F.get(j, F.lit(c)))
    return product * product


def freq_score(i: Column, j: Column) -> Column:
    return (i - j) * (i - j) * (i - j)


def acc_score(i: Column, j: Column) -> Column:
    return i - j


def _best(pairs: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "key_i", "key_j"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{c}_{side}" for c in ("key", "parts", "f", "a")})


def _before(size: int) -> Column:
    """Whether key i comes first: as a number for single keys, else as printed."""
    if size == 1:
        return F.get("parts_i", F.lit(0)) < F.get("parts_j", F.lit(0))
    return F.col("key_i") < F.col("key_j")


def _ordered(pairs: DataFrame, size: int, by: Sequence[str]) -> DataFrame:
    """Pairs with their first key as i; pairs of keys that are the same are left out."""
    before = _before(size)
    after = F.get("parts_i", F.lit(0)) > F.get("parts_j", F.lit(0)) if size == 1 else F.col("key_i") > F.col("key_j")
    sides = {
        f"{c}_{side}": F.when(before, F.col(f"{c}_{side}")).otherwise(F.col(f"{c}_{other}"))
        for c in ("key", "parts", "f", "a")
        for side, other in (("i", "j"), ("j", "i"))
    }
    return pairs.where(before | after).select(*by, *[e.alias(c) for c, e in sides.items()])


class Box(NamedTuple):
    """What a pair of nodes knows of one of them: lowest and highest key numbers (arrays), frequency, accuracy."""

    low: Column
    high: Column
    f_low: Column
    f_high: Column
    a_low: Column
    a_high: Column


def box_bound(i: Box, j: Box, size: int) -> Column:
    """No pair of a key of one box with a key of the other scores higher by the scorers of this module."""
    u0, u1 = freq_score(i.f_low, j.f_high), freq_score(i.f_high, j.f_low)
    v0, v1 = acc_score(i.a_low, j.a_high), acc_score(i.a_high, j.a_low)
    most = F.greatest(u0 * v0, u0 * v1, u1 * v0, u1 * v1)
    near = far = F.lit(1.0)
    for c in range(size):
        low_i, high_i, low_j, high_j = (F.get(e, F.lit(c)).cast("double") for e in (i.low, i.high, j.low, j.high))
        apart = F.greatest(low_i - high_j, low_j - high_i)
        near = near * F.when(apart > 0, apart).otherwise(F.lit(EQUAL_GAP))
        far = far * F.greatest(high_i - low_j, high_j - low_i, F.lit(EQUAL_GAP))
    # Two keys differ in one number at least, by one at least. The margins cover rounding.
    near = F.greatest(near, F.lit(EQUAL_GAP ** (size - 1))) * (1 - 1e-9)
    return most / F.pow(F.when(most > 0, near).otherwise(far * (1 + 1e-9)), 2)


def _coded(points: DataFrame, size: int, by: Sequence[str]) -> DataFrame:
    """Points with ``code``: their place in the cell's box, bits of the axes in turn, highest first."""
    even = lambda v: F.signum(v) * F.log1p(F.abs(v))  # noqa: E731  close to even for counts and numbers
    axes = [F.col("a"), even(F.col("f"))] + [even(F.get("parts", F.lit(c)).cast("double")) for c in range(size)]
    points = points.select("*", *[F.coalesce(e.cast("double"), F.lit(0.0)).alias(f"_x{k}") for k, e in enumerate(axes)])
    span = [x for k in range(len(axes)) for x in (F.min(f"_x{k}").alias(f"_lo{k}"), F.max(f"_x{k}").alias(f"_hi{k}"))]
    points = points.join(points.groupBy(*by).agg(*span), list(by))
    each = BITS // len(axes)
    for k in range(len(axes)):
        place = (F.col(f"_x{k}") - F.col(f"_lo{k}")) / (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * float(1 << each)
        place = F.when(F.col(f"_hi{k}") > F.col(f"_lo{k}"), F.least(F.floor(place), F.lit((1 << each) - 1))).otherwise(F.lit(0))
        points = points.withColumn(f"_q{k}", place.cast("bigint"))
    bit = lambda k, b: f"shiftleft(shiftright(_q{k}, {b}) & 1L, {len(axes) - 1 - k})"
    step = " + ".join(bit(k, "b") for k in range(len(axes)))
    code = F.expr(f"aggregate(sequence({each - 1}, 0), 0L, (code, b) -> shiftleft(code, {len(axes)}) + {step})")
    code = F.shiftleft(code, BITS - each * len(axes))
    return points.select(*by, "key", "parts", "f", "a", code.alias("code"))


def _node(level: int) -> Column:
    return F.shiftright("code", BITS - STEP * level)


def _nodes(points: DataFrame, level: int, size: int, by: Sequence[str]) -> DataFrame:
    """by, node, parent, keys, first, and the box of every node of a level."""
    part = lambda c: F.get("parts", F.lit(c))
    boxes = points.groupBy(*by, _node(level).alias("node")).agg(
        F.count(F.lit(1)).alias("keys"),
        F.min("key").alias("first"),
        F.array(*[F.min(part(c)) for c in range(size)]).alias("low"),
        F.array(*[F.max(part(c)) for c in range(size)]).alias("high"),
        *[e for c in "fa" for e in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))],
    )
    return boxes.withColumn("parent", F.shiftright("node", STEP))


BOXED = ("keys", "first", "low", "high", "f_low", "f_high", "a_low", "a_high")


def _boxed(nodes: DataFrame, side: str, by: Sequence[str]) -> DataFrame:
    return nodes.select(*by, *[F.col(c).alias(f"{c}_{side}") for c in ("node", "parent", *BOXED)])


def _alive(pairs: DataFrame, thresholds: DataFrame, size: int, by: Sequence[str], bound) -> DataFrame:
    """Pairs of nodes that may hold a pair of keys which reaches the threshold."""
    kept = pairs.join(thresholds, list(by), "left")
    if bound is not None:
        i, j = (Box(*[F.col(f"{c}_{side}") for c in BOXED[2:]]) for side in "ij")
        most = F.nanvl(-bound(i, j, size), F.lit(float("-inf"))).alias("score")
        first = F.struct(most, F.least("first_i", "first_j").alias("key_i"), F.greatest("first_i", "first_j").alias("key_j"))
        # One comparison, so that the bound is written into the plan once. NULL comes before all.
        kept = kept.where(F.col("score").isNull() | (first <= F.struct((-F.col("score")).alias("score"), "key_i", "key_j")))
    return kept.select(*by, "node_i", "node_j", "keys_i", "keys_j")


def _open(pairs: DataFrame, points: DataFrame, level: int, size: int, by: Sequence[str]) -> DataFrame:
    """All pairs of keys of the given pairs of nodes."""
    own = points.select(*by, _node(level).alias("node"), "key", "parts", "f", "a")
    found = pairs.select(*by, "node_i", "node_j")
    for side in "ij":
        found = found.join(_side(own, side).withColumnRenamed("node", f"node_{side}"), [*by, f"node_{side}"])
    return _ordered(found.where("node_i < node_j OR key_i < key_j"), size, by)


def seed_pairs(points: DataFrame, size: int, by: Sequence[str]) -> DataFrame:
    """The most frequent keys of a cell, and the first ones as printed, with every key, each pair once."""
    seeds = []
    for order in ([F.desc("f"), F.desc("a"), F.asc("key")], [F.asc("key")]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        seeds.append(points.select(*by, "key", "parts", "f", "a", place.alias("place")).where(F.col("place") <= SEEDS).drop("place"))
    chosen = seeds[0].unionByName(seeds[1]).dropDuplicates([*by, "key"])
    known = points.join(chosen.select(*by, "key", F.lit(True).alias("seed")), [*by, "key"], "left")
    salt = F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")
    every = _side(known.select(*by, "key", "parts", "f", "a", "seed", salt.alias("salt")), "j")
    some = _side(chosen.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALT)]))), "i")
    return _ordered(some.join(every, [*by, "salt"]).where("seed IS NULL OR key_i < key_j"), size, by)


def _thresholds(best: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    return best.where(F.col("rank") == n).select(*by, "score", "key_i", "key_j")


def _reaching(pairs: DataFrame, thresholds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scored pairs at or above the threshold of their cell."""
    least = thresholds.withColumnsRenamed({"score": "least", "key_i": "last_i", "key_j": "last_j"})
    kept = pairs.join(least, list(by), "left")
    ties = (F.col("score") == F.col("least")) & (F.struct("key_i", "key_j") <= F.struct(F.col("last_i").alias("key_i"), F.col("last_j").alias("key_j")))
    return kept.where(F.col("least").isNull() | (F.col("score") > F.col("least")) | ties).select(*pairs.columns)


def best_pairs(points: DataFrame, size: int, n: int, by: Sequence[str], scored, bound, watch=None) -> DataFrame:
    """The ``n`` best pairs of every cell, by rounds over pairs of nodes.

    ``points`` have ``by, key, parts, f, a``. ``watch`` is called with the pairs that every round opens.
    """
    by, spark = list(by), points.sparkSession
    points, path = written(_coded(points, size, by), "farthest-points")
    used = [path]
    kept = [*by, "score", "key_i", "key_j", "f_i", "f_j", "a_i", "a_j"]
    if bound is None:
        known = T.StructType([*[points.schema[c] for c in by], T.StructField("score", T.DoubleType())])
        thresholds = spark.createDataFrame([], known.add("key_i", "string").add("key_j", "string"))
    else:
        first = _best(scored(seed_pairs(points, size, by)).select(*kept), by, n)
        thresholds, path = written(_thresholds(first, n, by), "farthest-thresholds")
        used.append(path)

    roots = _nodes(points, 0, size, by)
    both = _boxed(roots, "i", by).join(_boxed(roots, "j", by), by)
    same = F.col("node_i") == F.col("node_j")
    inside = F.when(same, F.col("keys_i") * (F.col("keys_i") - 1) / 2).otherwise(F.col("keys_i") * F.col("keys_j"))
    small = inside <= OPENED
    alive, path = written(_alive(both, thresholds, size, by, bound), "farthest-nodes")
    used.append(path)
    best, end, level = None, None, 0
    while True:
        left = alive.agg(F.coalesce(F.sum(inside), F.lit(0)), F.coalesce(F.sum(F.when(small, inside)), F.lit(0))).first()
        done = bound is None or level == BITS // STEP or left[0] <= EAGER or left[0] == left[1]
        if done or left[1]:
            ready = alive if done else alive.where(small)
            if watch:
                watch(ready.select(inside.cast("bigint").alias("pairs")))
            found = _reaching(scored(_open(ready, points, level, size, by)).select(*kept), thresholds, by)
            if best is not None:
                found = found.unionByName(best.drop("rank"))
                used.append(end)
            best, end = written(_best(found, by, n), "farthest-best")
            # All of them reach the threshold before, so the n-th of them is the next one.
            risen = _thresholds(best, n, by)
            thresholds = thresholds.join(risen.select(*by), by, "left_anti").unionByName(risen)
        if done:
            break
        level += 1
        nodes = _nodes(points, level, size, by)
        wide = alive.where(~small).select(*by, F.col("node_i").alias("parent_i"), F.col("node_j").alias("parent_j"))
        wide = wide.join(_boxed(nodes, "i", by), [*by, "parent_i"]).join(_boxed(nodes, "j", by), [*by, "parent_j"])
        wide = wide.where("parent_i < parent_j OR node_i <= node_j")
        alive, path = written(_alive(wide, thresholds, size, by, bound), "farthest-nodes")
        used.append(path)
    for path in used:
        discard(spark, path)
    return best


def farthest_points(
    keys: DataFrame,
    size: int,
    n: int = 100,
    by: Sequence[str] = CELL,
    index_filter: Callable[[Column], Column] | None = None,
    index_score: Callable[[Column, Column, int], Column] = index_score,
    freq_score: Callable[[Column, Column], Column] = freq_score,
    acc_score: Callable[[Column, Column], Column] = acc_score,
    bound: Callable[[Box, Box, int], Column] | None = None,
    watch: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """The ``n`` best pairs per cell: ``by, rank, score, key_i, key_j, log_gap, a_i, a_j``.

    ``keys`` comes from ``key_accuracy`` with ``size`` numbers per key. ``index_filter`` maps the
    key numbers to a condition; by default keys with a one-digit or round number are left out.
    A pair is ordered by its key: as a number for single keys, else as printed. The scorers map the
    two keys' numbers, frequencies and accuracies to the parts of the score.

    ``bound`` belongs to scorers of the caller's: from two boxes and ``size`` it tells a number that no pair of
    a key in one and a key in the other (in either order) scores above. Without it such scorers compare
    all pairs, and a cell of more than ``UNBOUNDED`` keys is an error. ``watch`` is called each round with
    the opened pairs of nodes (``pairs``: their pairs of keys).
    """
    by = list(by)
    own = (index_score, freq_score, acc_score) == SCORERS
    allowed = index_filter(F.col("parts")) if index_filter else ~is_round_key(F.col("parts"))
    points = keys.where(allowed).select(
        *by, "key", "parts", F.col("frequency").alias("f"), F.col("accuracy").alias("a")
    )
    if not own and bound is None:
        largest = points.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if largest > UNBOUNDED:
            raise ValueError(f"a cell has {largest} keys; scorers without a bound take {UNBOUNDED} at most")

    def scored(pairs: DataFrame) -> DataFrame:
        gaps = index_score(F.col("parts_i"), F.col("parts_j"), size)
        score = freq_score(F.col("f_i"), F.col("f_j")) * acc_score(F.col("a_i"), F.col("a_j")) / gaps
        return pairs.withColumn("score", score.cast("double"))

    found = best_pairs(points, size, n, by, scored, box_bound if own and bound is None else bound, watch)
    log_gap = F.abs(F.log10("f_i") - F.log10("f_j")).alias("log_gap")
    return found.select(*by, "rank", "score", "key_i", "key_j", log_gap, "a_i", "a_j")


SCORERS = (index_score, freq_score, acc_score)
