"""Counting number and keyword tuples of whole texts, many texts at a time.

A task reads Arrow batches of texts, cuts them into tokens, and looks at every distinct token once: whether it
is a number, and which keyword it is. From there on tokens are integers, and the neighbours of all numbers
are read by shifted positions. Texts lie apart by a window, so no tuple crosses their ends. What leaves a
task are the counts of each block of texts, which are added up per key. Several counts share one pass over the
texts (``count_all``). On the way a key of up to three numbers of up to six ASCII digits is one integer, and the
integers of a block that go to the same part are one row; any other key travels as text.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termgauge.functions import text as tx

BLOCK_BYTES = 16 << 20  # of text that is counted at once


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """The texts of all batches in arrays of about ``BLOCK_BYTES``; NULL texts hold nothing."""
    held, size = [], 0
    for batch in batches:
        texts = batch.column(0).drop_null().cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
        first = 0
        while first < len(texts):
            before = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, before + BLOCK_BYTES - size)), first + 1)
            held.append(texts.slice(first, last - first))
            size += int(ends[last - 1] - before)
            first = last
            if size >= BLOCK_BYTES or first < len(texts):
                yield pa.concat_arrays(held)
                held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


class Block:
    """Tokens of some texts as places in the list of distinct ones (``words``), ``gap`` empty places after each text.

    ``at`` is the token of a place, -1 where there is none; ``number`` and ``decimal`` tell what it is, ``keyword`` which
    one of ``stems``, or -1; ``rank`` is the rank of a number. All have ``gap`` empty places at both ends.
    """

    def __init__(self, texts: pa.Array, gap: int, digit_limit: int, keywords: tx.Keywords | None):
        cut = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        ends = cut.offsets.to_numpy()
        coded = pc.dictionary_encode(cut.flatten())
        words, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        lengths, ends = np.diff(ends), ends[1:] - ends[0]
        at = np.full(len(ids) + (len(texts) + 1) * gap, -1, np.int32)
        at[np.arange(len(ids)) + np.repeat(np.arange(1, len(texts) + 1) * gap, lengths)] = ids
        decimal = _decimals(words)
        # Numbers are ranked as strings, so that the smaller of two is the first one of a key.
        rank = np.zeros(len(words) + 1, np.int32)
        places = np.flatnonzero(decimal)
        order = pc.array_sort_indices(words.take(places)).to_numpy()
        rank[places[order]] = np.arange(len(places))
        self.rank = rank[at]
        self.ranked = words.take(places[order])
        told = np.append(decimal, False)
        short = np.append(decimal & (pc.utf8_length(words).to_numpy(zero_copy_only=False) <= digit_limit), False)
        self.decimal, self.number, self.at = told[at], short[at], at
        if keywords is not None:
            found = {i: s for i, w in enumerate(words.to_pylist()) if keywords.may_match(w) and (s := keywords.stem_of(w)) is not None}
            self.stems = sorted(set(found.values()))
            stem = np.full(len(words) + 1, -1, np.int32)
            for i, s in found.items():
                stem[i] = self.stems.index(s)
            self.keyword = stem[at]
        starts = ends - lengths + np.arange(1, len(texts) + 1) * gap
        self.middle = (starts + lengths // 2)[lengths > 0]

    def ranks(self, places: np.ndarray) -> np.ndarray:
        return self.rank[places]


# Digits of any script that the regular expressions of the other operators know, which end at Unicode 13.
DIGITS = re.compile(r"(?:(?![\U00011f50-\U00011f59\U0001e4f0-\U0001e4f9])\d)+")


def _decimals(words: pa.Array) -> np.ndarray:
    """Which words are decimal digits of any script and nothing else."""
    found = pc.ascii_is_decimal(words).to_numpy(zero_copy_only=False).copy()
    for i in np.flatnonzero(~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)):
        found[i] = DIGITS.fullmatch(words[int(i)].as_py()) is not None
    return found


# Keys of a block come as rows: the ranks of their numbers, and the keyword if there is one.
Keys = Iterator[tuple[list[np.ndarray], np.ndarray | None]]


def _later(block: Block, first: np.ndarray, offsets: Sequence[int]) -> np.ndarray:
    """The places of ``first`` that have numbers at all of the offsets."""
    for d in offsets:
        first = first[block.number[first + d]]
    return first


def number_tuples(block: Block, num_count: int, window_size: int, centred: bool = False) -> Keys:
    """Every number with each choice of ``num_count - 1`` later ones less than ``window_size`` tokens away."""
    first = _anchors(block, block.number, centred)
    for offsets in itertools.combinations(range(1, window_size), num_count - 1):
        own = _later(block, first, offsets)
        yield [block.ranks(own + d) for d in (0, *offsets)], None


def word_tuples(block: Block, num_count: int, window_size: int, centred: bool = False) -> Keys:
    """The same with a keyword, all less than ``window_size`` tokens from it, met from their first number."""
    first, reach = _anchors(block, block.number, centred), window_size - 1
    for k in range(-reach, reach + 1):
        near = first[block.keyword[first + k] >= 0]
        yield from _around(block, near, k, num_count, reach)


def keyword_tuples(block: Block, num_count: int, window_size: int) -> Keys:
    """The same tuples, met from their keyword."""
    words, reach = np.flatnonzero(block.keyword >= 0), window_size - 1
    for k in range(-reach, reach + 1):
        first = words - k
        yield from _around(block, first[block.number[first]], k, num_count, reach)


def _around(block: Block, first: np.ndarray, k: int, num_count: int, reach: int) -> Keys:
    """Tuples of first numbers whose keyword is ``k`` tokens after them."""
    for offsets in itertools.combinations(range(max(1, k - reach), min(0, k) + reach + 1), num_count - 1):
        own = _later(block, first, offsets)
        yield [block.ranks(own + d) for d in (0, *offsets)], block.keyword[own + k]


def patterns(block: Block, window_size: int, centred: bool = False) -> Keys:
    """``number token number token number``, in text order."""
    first = _anchors(block, block.decimal if centred else block.number, centred)
    if window_size >= 5:
        own = first[block.decimal[first + 2] & block.decimal[first + 4]]
        yield [block.ranks(own + d) for d in (0, 2, 4)], None


def _anchors(block: Block, wanted: np.ndarray, centred: bool) -> np.ndarray:
    return block.middle[wanted[block.middle]] if centred else np.flatnonzero(wanted)


def _counted(block: Block, keys: Keys, in_order: bool) -> tuple[list[np.ndarray], np.ndarray | None, np.ndarray] | None:
    """Distinct keys of a block and how often they occur."""
    parts = [(n, w) for n, w in keys if len(n[0])]
    if not parts:
        return None
    columns = [np.concatenate(c) for c in zip(*[n for n, _ in parts])]
    if in_order and len(columns) == 2:
        columns = [np.minimum(*columns), np.maximum(*columns)]
    elif in_order and len(columns) > 2:
        for last in range(len(columns) - 1, 0, -1):  # the largest goes last, whole columns at a time
            for i in range(last):
                columns[i], columns[i + 1] = np.minimum(columns[i], columns[i + 1]), np.maximum(columns[i], columns[i + 1])
    sizes = [max(len(block.ranked), 1)] * len(columns)
    if parts[0][1] is not None:
        columns.append(np.concatenate([w for _, w in parts]).astype(np.int64))
        sizes.append(max(len(block.stems), 1))
    if np.prod([float(s) for s in sizes]) < 2.0**62:
        code = columns[0].astype(np.int64)
        for column, size in zip(columns[1:], sizes[1:]):
            code *= size
            code += column
        code.sort()
        begins = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        counts = np.diff(np.append(begins, len(code)))
        columns = list(np.unravel_index(code[begins], sizes))
    else:
        rows, counts = np.unique(np.stack(columns), axis=1, return_counts=True)
        columns = list(rows)
    words = columns.pop() if parts[0][1] is not None else None
    return columns, words, counts


NUMBER_BITS, NUMBER_DIGITS = 21, 6  # of a number within the integer of a key; the digits come after a 1
CODED = 63 // NUMBER_BITS  # numbers of a key at most that are one integer


class Count(NamedTuple):
    """One of several counts of the same texts: the columns of its numbers, its keys, whether a keyword comes with them."""

    names: Sequence[str]
    keys: Callable[[Block], Keys]
    keyword: bool = False
    in_order: bool = True


def _codes(ranked: pa.Array) -> np.ndarray:
    """The integer of every number, 0 for those that have none."""
    plain = pc.and_(pc.string_is_ascii(ranked), pc.less_equal(pc.binary_length(ranked), NUMBER_DIGITS))
    digits = pc.if_else(plain, ranked.cast(pa.large_string()), pa.scalar("", pa.large_string()))
    values = pc.binary_join_element_wise(pa.scalar("1", pa.large_string()), digits, pa.scalar("", pa.large_string()))
    return np.where(plain.to_numpy(zero_copy_only=False), values.cast(pa.int64()).to_numpy(), 0)


def _packed(block: Block, codes: np.ndarray, numbers: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Keys as integers, and as text where they are none."""
    whole, coded = np.zeros(len(numbers[0]), np.int64), np.full(len(numbers[0]), len(numbers) <= CODED)
    for place, ranks in enumerate(numbers[:CODED]):
        own = codes[ranks]
        whole |= own << (NUMBER_BITS * place)
        coded &= own > 0
    odd = np.flatnonzero(~coded)
    texts = pa.nulls(len(whole), pa.string())
    if len(odd):
        parts = [block.ranked.take(pa.array(ranks[odd])).cast(pa.string()) for ranks in numbers]
        joined = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
        texts = pc.replace_with_mask(texts, pa.array(~coded), joined)
    return pa.array(whole, mask=~coded), texts


def _number(place: int) -> Column:
    """The number at a place of a key."""
    code = F.shiftright("code", NUMBER_BITS * place).bitwiseAND(F.lit((1 << NUMBER_BITS) - 1)) if place < CODED else F.lit(0)
    return F.when(F.col("code").isNull(), F.get(F.split("odd", " "), F.lit(place))).otherwise(F.substring(code.cast("string"), 2, NUMBER_DIGITS))


COUNTED = "kind int, code bigint, odd string, keyword string, frequency bigint"
FIELDS = pa.schema([("kind", pa.int32()), ("code", pa.int64()), ("odd", pa.string()), ("keyword", pa.string()), ("frequency", pa.int64())])

# On the way: the integer keys of a block that share a part and a kind are one row, every other key is a row.
SENT = "part int, kind int, stems array<string>, entries int, packed binary, odd string, keyword string, frequency bigint"
SENT_FIELDS = pa.schema(
    [("part", pa.int32()), ("kind", pa.int32()), ("stems", pa.list_(pa.string())), ("entries", pa.int32()), ("packed", pa.binary())]
    + [("odd", pa.string()), ("keyword", pa.string()), ("frequency", pa.int64())]
)
PARTS_PER_TASK = 4
STEM, NO_STEM = np.dtype("<i2"), -1
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _part_of(code: np.ndarray, parts: int) -> np.ndarray:
    mixed = code.astype(np.uint64) * SPREAD
    return (((mixed ^ (mixed >> np.uint64(29))) * SPREAD) >> np.uint64(40)).astype(np.int64) % parts


def _squeezed(columns: Sequence[np.ndarray]) -> bytes:
    """Columns as planes of bytes; high bytes that are the same cost nothing."""
    return pa.compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), codec="zstd", asbytes=True)


def _opened(packed: bytes, entries: int) -> list[np.ndarray]:
    """Codes, places of stems and frequencies of a row."""
    kinds = [np.dtype("<i8"), STEM, np.dtype("<i8")]
    flat = np.frombuffer(pa.decompress(packed, entries * sum(k.itemsize for k in kinds), codec="zstd"), np.uint8)
    out, at = [], 0
    for kind in kinds:
        size = kind.itemsize
        out.append(np.ascontiguousarray(flat[at : at + entries * size].reshape(size, entries).T).view(kind).reshape(entries))
        at += entries * size
    return out


def _sent(kind: int, stems: Sequence[str], code: pa.Array, odd: pa.Array, words: np.ndarray | None, times: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The keys of a block on their way to their parts."""
    coded = code.is_valid().to_numpy(zero_copy_only=False)
    stem = np.full(len(times), NO_STEM, STEM) if words is None else words.astype(STEM)
    if coded.any():
        own, times_of, stem_of = code.drop_null().to_numpy(), times[coded].astype(np.int64), stem[coded]
        part = _part_of(own, parts)
        order = np.argsort(part, kind="stable")
        own, times_of, stem_of, part = own[order], times_of[order], stem_of[order], part[order]
        begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(begins[1:], len(part))
        packed = [_squeezed([c[b:e] for c in (own, stem_of, times_of)]) for b, e in zip(begins.tolist(), ends.tolist())]
        n = len(begins)
        columns = [pa.array(part[begins], pa.int32()), pa.repeat(pa.scalar(kind, pa.int32()), n), pa.array([stems] * n, pa.list_(pa.string()))]
        columns += [pa.array(ends - begins, pa.int32()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], schema=SENT_FIELDS)
    rest = np.flatnonzero(~coded)
    for start in range(0, len(rest), ROWS):
        at = rest[start : start + ROWS]
        texts = odd.take(pa.array(at))
        part = [zlib.crc32(t.encode()) % parts for t in texts.to_pylist()]
        keyword = pa.nulls(len(at), pa.string()) if words is None else pa.array(stems, pa.string()).take(pa.array(words[at]))
        columns = [pa.array(part, pa.int32()), pa.repeat(pa.scalar(kind, pa.int32()), len(at)), pa.nulls(len(at), pa.list_(pa.string()))]
        columns += [pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary()), texts, keyword, pa.array(times[at], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=SENT_FIELDS)


def _of_part(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Keys of a part with the sum of their counts."""
    packed = rows.filter(pc.is_valid(rows.column("packed")))
    stems = sorted(pc.list_flatten(packed.column("stems")).unique().to_pylist())
    place = {s: i for i, s in enumerate(stems)}
    names = pa.array([*stems, None], pa.string())
    for kind in pc.unique(packed.column("kind")).to_pylist():
        parts = []
        of_kind = packed.filter(pc.equal(packed.column("kind"), kind))
        for own, n, data in zip(*(of_kind.column(c).to_pylist() for c in ("stems", "entries", "packed"))):
            code, stem, times = _opened(data, n)
            parts.append((code, np.array([*(place[s] for s in own), NO_STEM], np.int64)[stem], times))
        code, stem, times = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(code) if (stem == NO_STEM).all() else np.lexsort((code, stem))
        code, stem = code[order], stem[order]
        begins = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (stem[1:] != stem[:-1])))
        times = np.add.reduceat(times[order], begins)
        code, keyword = code[begins], names.take(pa.array(stem[begins] % len(names)))
        columns = [pa.repeat(pa.scalar(kind, pa.int32()), len(code)), pa.array(code), pa.nulls(len(code), pa.string()), keyword, pa.array(times)]
        yield pa.RecordBatch.from_arrays(columns, schema=FIELDS)
    odd = rows.filter(pc.is_null(rows.column("packed"))).select(["kind", "odd", "keyword", "frequency"])
    if len(odd):
        summed = odd.group_by(["kind", "odd", "keyword"]).aggregate([("frequency", "sum")])
        columns = [summed.column("kind"), pa.nulls(len(summed), pa.int64()), *(summed.column(c) for c in ("odd", "keyword", "frequency_sum"))]
        yield from pa.table(columns, schema=FIELDS).to_batches()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with the sum of their counts; rows come sorted by part."""

    def parts() -> Iterator[pa.Table]:
        held, here = [], None
        for batch in batches:
            part = batch.column(0).to_numpy()
            for rows in np.split(np.arange(len(part)), np.flatnonzero(part[1:] != part[:-1]) + 1):
                if not len(rows):
                    continue
                if held and part[rows[0]] != here:
                    yield pa.Table.from_batches(held)
                    held = []
                here = part[rows[0]]
                held.append(batch.slice(int(rows[0]), len(rows)))
        if held:
            yield pa.Table.from_batches(held)

    for table in parts():
        for batch in _of_part(table):
            for start in range(0, len(batch), ROWS):
                yield batch.slice(start, ROWS)


def count_all(
    texts: DataFrame, counts: Sequence[Count], gap: int, digit_limit: int = 6, keywords: tx.Keywords | None = None
) -> DataFrame:
    """All ``counts`` in one pass over the column ``text``, for ``count_of``. ``gap`` has to do for each of them.

    The counts of a block travel as one row for each part of the keys and kind of count; a task adds up the counts of a part.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) * PARTS_PER_TASK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _blocks(batches):
            block = Block(texts, gap, digit_limit, keywords)
            codes = _codes(block.ranked)
            for kind, one in enumerate(counts):
                found = _counted(block, one.keys(block), one.in_order)
                if found is None:
                    continue
                numbers, words, times = found
                yield from _sent(kind, [] if words is None else block.stems, *_packed(block, codes, numbers), words, times, parts)

    sent = texts.select("text").mapInArrow(run, SENT)
    return sent.repartition(parts // PARTS_PER_TASK, "part").sortWithinPartitions("part").mapInArrow(_summed, COUNTED)


def count_of(counted: DataFrame, kind: int, count: Count) -> DataFrame:
    """``names[, keyword], frequency`` of one of the counts of ``count_all``, by its place there."""
    numbers = [_number(place).alias(name) for place, name in enumerate(count.names)]
    return counted.where(F.col("kind") == kind).select(*numbers, *["keyword"] * count.keyword, "frequency")


def count(
    texts: DataFrame,
    names: Sequence[str],
    keys: Callable[[Block], Keys],
    gap: int,
    digit_limit: int = 6,
    keywords: tx.Keywords | None = None,
    in_order: bool = True,
) -> DataFrame:
    """``names, frequency`` of the keys that ``keys`` finds in the column ``text``; with ``keywords`` a keyword comes
    after the numbers. Numbers of a key are in string order unless told otherwise."""
    one = Count(names, keys, keywords is not None, in_order)
    return count_of(count_all(texts, [one], gap, digit_limit, keywords), 0, one)


ROWS = 50_000  # of a batch that leaves a task
