"""Benchmark items found in documents: SimHash of item-sized windows, then exact similarity.

The shingles of an item (``WORDS`` words, letters A-Z lower-cased) are counted; the counts are their
weights. A window is as many shingles of a document as an item has; a document that has fewer is one
window as a whole, if it has ``SIMILARITY`` times as many at least (with fewer it cannot be similar).
A window without any shingle of an item has similarity 0 to it, and one with too few shingles of any
item is below the limit, so only windows around shared shingles are looked at; none is lost by that.
Their fingerprints come from running sums of the shingles' bits. ``BLOCKS`` blocks of a fingerprint are looked up: two fingerprints that differ in
at most ``RADIUS`` bits differ in at most ``RADIUS // BLOCKS`` bits of some block, and all values
that near are tried, so no pair within the radius is missed. For what is found the weighted Jaccard
similarity (sum of smaller counts by sum of larger counts) decides exactly.

The benchmark goes to the tasks in slices of about ``SLICE_BYTES`` by hash of the item; a larger
benchmark takes more passes over the documents, not larger broadcasts. Rows of documents are never
shuffled to be compared, so hot documents and passages cost no more than others.

An item of fewer than ``WORDS`` words is one shingle of all its words. Defined results: NULL, empty
and blank documents and items match nothing; repeated rows each have their matches; equal items
all match; of the windows that are most similar to an item the first is given, with the number of
its own words; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termgauge.llm import textbuf

WORDS = 5
SIMILARITY = 0.8
RADIUS, BLOCKS = 23, 8
SLICE_BYTES = 32 << 20
TABLE_BITS = 20
MATCHES = "doc_id bigint, item_id bigint, start_word bigint, n_words bigint, similarity double"
NEAR = [0] + [
    sum(1 << b for b in bits) for n in range(1, RADIUS // BLOCKS + 1) for bits in combinations(range(64 // BLOCKS), n)
]


def signs(hashes: np.ndarray) -> np.ndarray:
    """1 or -1 for each bit of each hash."""
    own = textbuf.mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    return (np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) << 1) - 1


def fingerprints(totals: np.ndarray) -> np.ndarray:
    """Bytes of the fingerprints of summed signs: a row of 8 for each."""
    return np.packbits(totals > 0, axis=1)


class Index:
    """Items by number of shingles, with block tables of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []
        sized: dict[tuple[int, int], list[int]] = defaultdict(list)
        owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            starts, ends, rows = textbuf.spans(data, np.array([0, len(data)]))
            if not len(starts):
                continue
            k = min(WORDS, len(starts))
            _, found = textbuf.windows(textbuf.word_hashes(data, starts, ends, lower=True), rows, k)
            at = len(self.items)
            self.items.append((item_id, len(starts), Counter(found.tolist()), fingerprints(signs(found).sum(0)[None])[0]))
            sized[k, len(found)].append(at)
            for h in set(found.tolist()):
                owners[k][h].add(len(found))
        self.owners = {k: {h: sorted(m) for h, m in own.items()} for k, own in owners.items()}
        self.known, self.table = {}, {}
        for k, own in self.owners.items():
            self.known[k] = np.sort(np.array(list(own), np.uint64))
            marks = np.zeros(1 << TABLE_BITS, bool)
            marks[(self.known[k] >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
            self.table[k] = marks
        self.blocks = {}
        for size, own in sized.items():
            tables = [defaultdict(list) for _ in range(BLOCKS)]
            for at in own:
                for table, value in zip(tables, self.items[at][3].tolist()):
                    table[value].append(at)
            self.blocks[size] = tables

    def near(self, size: tuple[int, int], fingerprint: np.ndarray) -> set[int]:
        """Items of the size within the radius."""
        able = set()
        for table, value in zip(self.blocks[size], fingerprint.tolist()):
            for flip in NEAR:
                able.update(table.get(value ^ flip, ()))
        return {a for a in able if int(np.bitwise_count(self.items[a][3] ^ fingerprint).sum()) <= RADIUS}

    def matches(self, k: int, hashes: np.ndarray, hits: np.ndarray):
        """item, first shingle, shingles, similarity of the most similar window of each matched item."""
        best: dict[int, tuple[float, int]] = {}
        wanted: dict[int, set[int]] = defaultdict(set)
        for p in hits.tolist():
            for m in self.owners[k][int(hashes[p])]:
                size = min(m, len(hashes))
                if size >= SIMILARITY * m - 1e-9:
                    wanted[m].update(range(max(0, p - size + 1), min(p, len(hashes) - size) + 1))
        shared = np.zeros(len(hashes) + 1, np.int64)
        shared[hits + 1] = 1
        shared = np.cumsum(shared)
        for m, places in wanted.items():
            at = np.array(sorted(places), np.int64)
            size = min(m, len(hashes))
            # Of m and size shingles, s * (m + size) / (1 + s) are common at least where similarity is s.
            enough = (1 + SIMILARITY) * (shared[at + size] - shared[at]) >= SIMILARITY * (m + size) - 1e-9
            at = at[enough]
            for run in np.split(at, np.flatnonzero(np.diff(at) > size) + 1):
                if not len(run):
                    continue
                lo = int(run[0])
                total = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(signs(hashes[lo : run[-1] + size]), axis=0)])
                prints = fingerprints(total[run - lo + size] - total[run - lo])
                for p, own in zip(run.tolist(), prints):
                    found = self.near((k, m), own)
                    if not found:
                        continue
                    window = Counter(hashes[p : p + size].tolist())
                    for a in found:
                        weights = self.items[a][2]
                        both = sum(min(n, weights[h]) for h, n in window.items() if h in weights)
                        similarity = both / (m + size - both)
                        if similarity >= SIMILARITY and similarity > best.get(a, (0.0, 0, 0))[0]:
                            best[a] = (similarity, p, size)
        return [(a, p, size, s) for a, (s, p, size) in best.items()]


    def scan(self, column: pa.Array):
        """row, item, first word, words, similarity of the most similar window of each matched item."""
        for lo, _, data, offsets in textbuf.chunks(column):
            starts, ends, rows = textbuf.spans(data, offsets)
            words = textbuf.word_hashes(data, starts, ends, lower=True)
            heads = np.searchsorted(rows, np.arange(len(offsets)))
            for k, known in self.known.items():
                first, hashes = textbuf.windows(words, rows, k)
                hit = np.flatnonzero(self.table[k][(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
                at = np.minimum(np.searchsorted(known, hashes[hit]), len(known) - 1)
                hit = hit[known[at] == hashes[hit]]
                if not len(hit):
                    continue
                owner = rows[first]
                for own in np.split(hit, np.flatnonzero(np.diff(owner[hit])) + 1):
                    row = int(owner[own[0]])
                    a, b = np.searchsorted(owner, [row, row + 1])
                    for item, p, size, similarity in self.matches(k, hashes[a:b], own - a):
                        yield lo + row, self.items[item][0], int(first[a + p] - heads[row]), size + k - 1, similarity


def find(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """A row of ``MATCHES`` for every document and item of which it has a similar window."""
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = None
    for shared in _slices(benchmark, item, item_text):
        one = rows.mapInArrow(_finder(shared), MATCHES)
        found = one if found is None else found.unionByName(one)
    return found


def without_matches(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``documents`` that have no window similar to an item."""
    for shared in _slices(benchmark, item, item_text):
        documents = documents.mapInArrow(_keeper(shared, documents.columns.index(text)), documents.schema)
    return documents


def _slices(benchmark: DataFrame, item: str, item_text: str):
    """The benchmark as broadcast lists of (item, text), each of about ``SLICE_BYTES``."""
    items = benchmark.select(F.col(f"`{item}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    slices = int(size) // SLICE_BYTES + 1
    for part in range(slices):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == part) if slices > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in own.collect()), key=str))


def _keeper(shared, at: int):
    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            hit = {row for row, *_ in index.scan(batch.column(at))}
            yield batch.filter(pa.array([row not in hit for row in range(batch.num_rows)], pa.bool_()))

    return run


def _finder(shared):
    names = [x.split()[0] for x in MATCHES.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.float64()]

    def run(batches):
        index = Index(shared.value)
        for batch in batches:
            ids = batch.column(0)
            out = [(ids[row].as_py(), *found) for row, *found in index.scan(batch.column(1))]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run
