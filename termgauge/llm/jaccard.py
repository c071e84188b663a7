"""Groups of documents linked by the Jaccard similarity of their word shingles, found exactly.

1. Every text gives its set of distinct shingles (64-bit hashes), the size and a fingerprint of
   the set. Texts with equal sets are one class and go on as one.
2. Two sets of the wanted similarity share one of the first ``n - need + 1`` shingles of each, in
   any order that all sets use: shingles of rare words first (a fixed number of counters of words
   tells how common they are), then by hash. So few sets meet by chance, and not more of them in a
   larger corpus. Rows (shingle, fingerprint, size) meet by shingle; shingles with
   one class go, and shingles with the same classes become one bucket, as do those of at most ``FEW``
   classes with the same smallest fingerprint, but for parts that keep a bucket to about ``BLOCK`` classes.
3. In a bucket, signature trees decide which classes can be linked at all. A class has a bitmap of
   at least twice as many bits as shingles; a node has the OR of its bitmaps and a range of sizes. Two
   nodes are traversed together unless the largest overlap that bitmaps and sizes allow is too
   small, or everything below is connected already. Of each bucket only a star of each connected
   group goes on, never all pairs.
4. The connected groups of all stars contain every linked group. Within each, the same traversal
   runs over exact bitmaps, with a bit for every shingle that two or more of the group's sets hold,
   and gives stars of true links, whose components are the result. Only one text of a class that can be
   linked moves, compressed; a table of ``WANTED`` bits keeps back most others.

Buckets and groups of more than ``BLOCK`` classes are cut into blocks by size and hash, and a task
holds two blocks at most, so no task grows with a group. Nothing but tables of at most ``SLOTS``
numbers and ``WANTED`` bits goes over the driver.

Defined results: letters A-Z are lower-cased; a text of fewer words than a shingle has its whole
sequence as one shingle; NULL, empty and blank texts have size 0 and are linked with nothing;
repeated rows each keep their row; a group's id is its smallest key, and NULL if all keys are
NULL; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termgauge.llm import textbuf
from termgauge.llm.components import components
from termgauge.llm.grouping import block_pairs, groups
from termgauge.llm.memory import freed
from termgauge.llm.squeeze import expanded, squeezed
from termgauge.operators.skew import left_lookup
from termgauge.session import materialise

WORDS, PERCENT = 4, 85
SLOTS = 1 << 16
WANTED = 1 << 23
BLOCK = 4096
FEW = 32
LEAF, FANOUT = 32, 8


def shingle_sets(column: pa.Array, k: int, counts: np.ndarray | None = None):
    """(row, sorted distinct shingle hashes) of every text with a word; its words are added to ``counts``."""
    for lo, hi, data, offsets in textbuf.chunks(column):
        starts, ends, rows = textbuf.spans(data, offsets)
        hashes = textbuf.word_hashes(data, starts, ends, lower=True)
        if counts is not None:
            counts += np.bincount(word_slots(hashes), minlength=SLOTS)
        first, found = textbuf.windows(hashes, rows, k, short=True)
        cuts = np.searchsorted(rows[first], np.arange(hi - lo + 1))
        for row in range(hi - lo):
            if cuts[row] < cuts[row + 1]:
                yield lo + row, np.unique(found[cuts[row] : cuts[row + 1]])


def ordered_sets(column: pa.Array, k: int, weights: np.ndarray):
    """Like ``shingle_sets``, in the order of all sets: shingles of small ``weights`` of words first, then by hash."""
    for lo, hi, data, offsets in textbuf.chunks(column):
        starts, ends, rows = textbuf.spans(data, offsets)
        hashes = textbuf.word_hashes(data, starts, ends, lower=True)
        first, found = textbuf.windows(hashes, rows, k, short=True)
        total = np.r_[0, np.cumsum(weights[word_slots(hashes)])]
        sums = total[np.minimum(first + k, len(hashes))] - total[first]  # of a short text's one shingle, any will do
        sums = np.minimum(sums, 0xFFFF).astype(np.uint16)
        cuts = np.searchsorted(rows[first], np.arange(hi - lo + 1))
        for row in range(hi - lo):
            if cuts[row] < cuts[row + 1]:
                own, at = np.unique(found[cuts[row] : cuts[row + 1]], return_index=True)
                yield lo + row, own, np.argsort(sums[cuts[row] : cuts[row + 1]][at], kind="stable")


def word_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    total = textbuf.mix(hashes ^ np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64)
    return int(textbuf.mix(np.array([total ^ np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def signature(hashes: np.ndarray) -> bytes:
    """A bitmap of the hashes, with a power of two of bits, twice as many as hashes at least."""
    bits = max(64, 2 << int(len(hashes) - 1).bit_length())
    marks = np.zeros(bits, np.uint8)
    marks[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


# ------------------------------------------------------------------ sets and prefixes

SIZED = "doc_id bigint, text_hash bigint, n bigint, fp bigint, sig binary, slot bigint, words bigint"
SIZED_NAMES = [x.split()[0] for x in SIZED.split(", ")]


def _sizes(k: int):
    def run(batches):
        slots = np.zeros(SLOTS, np.int64)
        for batch in batches:
            n, fp = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            sig: list[bytes | None] = [None] * batch.num_rows
            for row, own in shingle_sets(batch.column(1), k, slots):
                n[row], fp[row], sig[row] = len(own), fingerprint(own), signature(own)
            none = pa.nulls(batch.num_rows, pa.int64())
            columns = [batch.column(0), batch.column(2), pa.array(n), pa.array(fp), pa.array(sig, pa.binary()), none, none]
            yield pa.RecordBatch.from_arrays(columns, SIZED_NAMES)
        at = np.flatnonzero(slots)
        none = pa.nulls(len(at), pa.int64())
        columns = [none, none, none, none, pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(slots[at])]
        yield pa.RecordBatch.from_arrays(columns, SIZED_NAMES)

    return run


def _prefixes(k: int, percent: int, weights: np.ndarray):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            tokens, fps, sizes = [], [], []
            for _, own, order in ordered_sets(batch.column(0), k, weights):
                if (fp := fingerprint(own)) in seen:
                    continue
                seen.add(fp)
                n = len(own)
                own = own[order[: n - -(-percent * n // 100) + 1]]
                tokens.append(own.view(np.int64))
                fps.append(np.full(len(own), fp))
                sizes.append(np.full(len(own), n))
                if len(tokens) == 1000:
                    yield _prefix_rows(tokens, fps, sizes)
                    tokens, fps, sizes = [], [], []
            if tokens:
                yield _prefix_rows(tokens, fps, sizes)

    return run


def _prefix_rows(tokens, fps, sizes):
    columns = [pa.array(np.concatenate(x)) for x in (tokens, fps, sizes)]
    return pa.RecordBatch.from_arrays(columns, ["token", "id", "n"])


def _buckets(percent: int):
    """From rows sorted by token, size and id: bucket, id, n of the runs of compatible sizes."""

    def close(token, fp, n):
        keep = np.r_[True, (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])]
        token, fp, n = token[keep], fp[keep], n[keep]
        head = np.r_[True, (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])]
        at = np.flatnonzero(head)
        length = np.diff(at, append=len(fp))
        mixed = textbuf.mix(fp.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93))
        members = textbuf.mix(np.add.reduceat(mixed, at) ^ length.astype(np.uint64)).view(np.int64)
        least = np.minimum.reduceat(fp, at)
        size = n[fp == np.repeat(least, length)]  # of the smallest class of each run
        parts = (size - -(-percent * size // 100) + 1) * FEW // BLOCK + 1
        part = textbuf.mix(token[at].view(np.uint64)) % parts.astype(np.uint64)
        common = textbuf.mix(least.view(np.uint64) ^ textbuf.mix(part + np.uint64(1))).view(np.int64)
        members = np.where(length <= FEW, common, members)
        wanted = np.repeat(length > 1, length)
        columns = [np.repeat(members, length)[wanted], fp[wanted], n[wanted]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "n"])

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # sorted: the last token may go on
            if cut:
                yield close(*(x[:cut] for x in rows))
            kept = [x[cut:] for x in rows]
        if kept is not None and len(kept[0]):
            yield close(*kept)

    return run


MEMBER = "key bigint, pair bigint, side int, id bigint, n bigint, hashes binary"


def _members(k: int):
    """From rows sorted by key and pair, with their squeezed text: the whole set, once, if the text is of the row's class."""
    names = [x.split()[0] for x in MEMBER.split(", ")]

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        last, seen = None, set()
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                texts = pa.array([expand(x) for x in batch.column(5).to_pylist()], pa.binary())
                ids = batch.column(3).to_numpy()
                pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                found = []
                for row, own in shingle_sets(texts, k):
                    if pairs[row] != last:
                        last, seen = pairs[row], set()
                    if fingerprint(own) == ids[row] and ids[row] not in seen:
                        seen.add(ids[row])
                        found.append((row, own.tobytes()))
                rows = pa.array([row for row, _ in found], pa.int64())
                columns = [batch.column(i).take(rows) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x for _, x in found], pa.binary())], names)

    return run


def _wanted_texts(bits: np.ndarray):
    """From rows with the hash of their text: those whose hash has its bit, with the text squeezed."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            at = whole.column(1).to_numpy().view(np.uint64) & np.uint64(WANTED - 1)
            rows = np.flatnonzero(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
            for lo in range(0, len(rows), 1000):
                key, text_hash, text = (c.take(pa.array(rows[lo : lo + 1000])) for c in whole.columns)
                text = pa.array([squeeze(x.encode()) for x in text.to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([key, text_hash, text], ["doc_id", "text_hash", "text"])

    return run


# ------------------------------------------------------------------ signature trees


class Forest:
    """Which of a task's members are connected."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def settle(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of fewer words: halves are OR-combined."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


class Node:
    """OR of the members' bitmaps, range of sizes, and how many shingles share a bit at most."""

    __slots__ = ("lo", "hi", "bits", "small", "large", "slack", "below")

    def __init__(self, lo, hi, bits, small, large, slack, below):
        self.lo, self.hi, self.bits, self.small, self.large, self.slack, self.below = lo, hi, bits, small, large, slack, below


class Tree:
    """Members sorted by size, ``LEAF`` to a leaf, ``FANOUT`` nodes to a node.

    ``rows`` holds the members' bitmaps. If they are ``exact``, a bit stands for one shingle and
    shingles without a bit are in one member only; else several shingles may share a bit. Bitmaps of a
    leaf have one width: folded to that of a smaller member, they would allow almost any overlap.
    """

    def __init__(self, members: np.ndarray, sizes: np.ndarray, rows: list[np.ndarray], exact: bool = False):
        self.members, self.sizes, self.exact = members, sizes, exact
        self.leaves = {}
        nodes = []
        widths = np.array([len(x) for x in rows])
        runs = np.r_[0, np.flatnonzero(widths[1:] != widths[:-1]) + 1, len(rows)]
        for lo, hi in [(lo, min(end, lo + LEAF)) for at, end in zip(runs, runs[1:]) for lo in range(at, end, LEAF)]:
            matrix = np.stack(rows[lo:hi])
            self.leaves[lo] = matrix
            n = sizes[lo:hi]
            slack = 0 if exact else int((n - np.bitwise_count(matrix).sum(1, dtype=np.int64)).max())
            nodes.append(Node(int(lo), int(hi), np.bitwise_or.reduce(matrix), int(n[0]), int(n[-1]), slack, None))
        while len(nodes) > 1:
            upper = []
            for at in range(0, len(nodes), FANOUT):
                own = nodes[at : at + FANOUT]
                words = min(len(x.bits) for x in own)
                bits = np.bitwise_or.reduce([fold(x.bits, words) for x in own])
                slack = max(x.large for x in own) if any(len(x.bits) > words for x in own) else max(x.slack for x in own)
                upper.append(Node(own[0].lo, own[-1].hi, bits, own[0].small, own[-1].large, slack, own))
            nodes = upper
        self.top = nodes[0]


def shared_bitmaps(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Bitmaps of the hashes that two or more sets hold: their overlaps are exact."""
    hashes = np.concatenate(sets)
    hashes.sort()
    shared = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
    del hashes
    words = max(1, -(-len(shared) // 64))
    out = []
    for own in sets:
        at = np.searchsorted(shared, own)
        bits = at[at < len(shared)]
        bits = bits[shared[bits] == own[at < len(shared)]]
        row = np.zeros(words * 64, np.uint8)
        row[bits] = 1
        out.append(np.packbits(row, bitorder="little").view(np.uint64))
    return out


def _possible(p: Node, q: Node, percent: int) -> bool:
    low, high = (p, q) if p.small <= q.small else (q, p)
    if 100 * low.large < percent * high.small:
        return False
    if len(p.bits) == len(q.bits):
        common = int(np.bitwise_count(p.bits & q.bits).sum())
        overlap = min(p.large, q.large, common + min(p.slack, q.slack))
    else:
        overlap = min(p.large, q.large)
    return (100 + percent) * overlap >= percent * (p.small + q.small)


def traverse(a: Tree, b: Tree, forest: Forest, percent: int) -> None:
    """Connect members of two trees (or of one with itself) that can be linked; with exact bitmaps, that are."""
    stack = [(a.top, b.top)]
    while stack:
        p, q = stack.pop()
        if p is not q or p.below:
            if not _possible(p, q, percent):
                continue
        mine, other = a.members[p.lo : p.hi], b.members[q.lo : q.hi]
        roots = {forest.root(i) for i in (mine[0], mine[-1], other[0], other[-1])}
        if len(roots) == 1:
            settled, root = forest.settle(), roots.pop()
            if (settled[mine] == root).all() and (settled[other] == root).all():
                continue
        if p.below and (not q.below or p.hi - p.lo >= q.hi - q.lo):
            if p is q and a is b:
                own = p.below
                stack += [(own[i], own[j]) for i in range(len(own)) for j in range(i, len(own))]
            else:
                stack += [(x, q) for x in p.below]
        elif q.below:
            stack += [(p, x) for x in q.below]
        else:
            _leaves(a, b, p, q, forest, percent)


def _leaves(a: Tree, b: Tree, p: Node, q: Node, forest: Forest, percent: int) -> None:
    x, y = a.leaves[p.lo], b.leaves[q.lo]
    words = min(x.shape[1], y.shape[1])
    x, y = fold(x, words), fold(y, words)
    n, m = a.sizes[p.lo : p.hi, None], b.sizes[None, q.lo : q.hi]
    overlap = np.zeros((len(x), len(y)), np.int64)
    for lo in range(0, words, 64):
        overlap += np.bitwise_count(x[:, None, lo : lo + 64] & y[None, :, lo : lo + 64]).sum(2, dtype=np.int64)
    if not a.exact:
        extra_x = n[:, 0] - np.bitwise_count(x).sum(1, dtype=np.int64)
        extra_y = m[0] - np.bitwise_count(y).sum(1, dtype=np.int64)
        overlap = np.minimum(np.minimum(n, m), overlap + np.minimum(extra_x[:, None], extra_y[None, :]))
    able = ((100 + percent) * overlap >= percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    settled = forest.settle()
    mine, other = a.members[p.lo : p.hi], b.members[q.lo : q.hi]
    able &= settled[mine][:, None] != settled[other][None, :]
    if p is q and a is b:
        able &= np.tri(len(n), m.shape[1], -1, dtype=bool).T
    for i, j in zip(*np.nonzero(able)):
        forest.join(int(mine[i]), int(other[j]))


def _stars(percent: int, k: int | None = None):
    """From rows sorted by key and pair: edges from the first member of each connected group.

    The last column holds signatures, or with ``k`` squeezed texts, whose sets are compared exactly.
    """
    exact = k is not None

    def run(batches):
        left, right, size = [], [], 0
        for table in groups(_members(k)(batches) if exact else batches, 2):
            side = table.column(2).to_numpy()
            ids, n = table.column(3).to_numpy(), table.column(4).to_numpy()
            order = np.lexsort((ids, n))
            side, ids, n = side[order], ids[order], n[order]
            rows = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(5)]
            rows = [rows[i] for i in order]
            if exact:
                rows = shared_bitmaps(rows)
            forest = Forest(len(ids))
            whole = np.arange(len(ids))
            trees = [Tree(own, n[own], [rows[i] for i in own], exact) for own in (whole[side == s] for s in (0, 1, 2)) if len(own)]
            if len(trees) == 2:
                traverse(trees[0], trees[1], forest, percent)
            elif side[0] == 2:
                traverse(trees[0], trees[0], forest, percent)
            up = forest.settle()
            at = np.flatnonzero(up != whole)
            if len(at):
                left.append(ids[up[at]])
                right.append(ids[at])
                size += len(at)
            if size >= 10_000:
                yield _edges(left, right)
                left, right, size = [], [], 0
        if size:
            yield _edges(left, right)

    return run


def _edges(left, right):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


# ------------------------------------------------------------------ the join


def jaccard_groups(
    documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for every row of ``documents``.

    ``text_hash`` is xxhash64 of the text. Two texts are linked if 100 * intersection >= ``percent`` * union of their ``k``-word shingles.
    """
    ratio = percent / 100
    rows = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    sized = materialise(hashed.mapInArrow(freed(_sizes(k)), SIZED), "jaccard-sizes")
    weights = _weights(sized)
    docs = sized.where("n IS NOT NULL").select("doc_id", "text_hash", "n", "fp")
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))  # NULL last
    classes = sized.where("n > 0").groupBy("fp").agg(one.alias("one"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    classes = classes.select("fp", F.col("one.doc_id").alias("first"), F.col("one.text_hash").alias("first_hash"), "n", "sig")
    classes = materialise(classes, "jaccard-classes")

    prefixes = rows.select("text").mapInArrow(freed(_prefixes(k, percent, weights)), "token bigint, id bigint, n bigint")
    met = prefixes.repartition("token").sortWithinPartitions("token", "n", "id")
    buckets = materialise(met.mapInArrow(freed(_buckets(percent)), "key bigint, id bigint, n bigint").distinct(), "jaccard-buckets")

    signed = block_pairs(buckets, BLOCK, ratio).join(classes.select(F.col("fp").alias("id"), "sig"), "id")
    stars = _run_stars(signed.select("key", "pair", "side", "id", "n", "sig"), percent)
    able = components(stars, "jaccard-able")

    grouped = able.select(F.col("root").alias("key"), "id").join(classes.select(F.col("fp").alias("id"), "n"), "id")
    paired = block_pairs(grouped.select("key", "n", "id"), BLOCK, ratio)
    firsts = classes.select(F.col("fp").alias("id"), "first", "first_hash")
    bits = _wanted_bits(able.join(firsts, "id"))
    wanted = paired.join(firsts, "id")
    texts = hashed.where("text IS NOT NULL").select("doc_id", "text_hash", "text")
    texts = texts.mapInArrow(freed(_wanted_texts(bits)), "doc_id bigint, text_hash bigint, text binary")
    whole = wanted.join(texts, (wanted["first_hash"] == texts["text_hash"]) & wanted["first"].eqNullSafe(texts["doc_id"]))
    links = _run_stars(whole.select("key", "pair", "side", "id", "n", "text"), percent, k)
    linked = components(links, "jaccard-links")

    named = linked.join(classes, linked["id"] == classes["fp"])
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = linked.join(smallest, "root").select(F.col("id").alias("fp"), "component_id")
    answer = classes.join(answer, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    found = left_lookup(docs, materialise(answer, "jaccard-answer"), ["fp"])
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each_group(
    documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``documents`` without all but the first of each group, by key and hash of the text.

    Rows that are equal in key and text count once. Texts without words are linked with nothing.
    """
    groups_of = jaccard_groups(documents, key, text, k, percent)
    group = F.struct("component_id", F.when(F.col("component_id").isNull() | (F.col("n_shingles") == 0), F.col("text_hash")))
    firsts = groups_of.groupBy(group.alias("group")).agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    taken = {c.lower() for c in documents.columns}
    names = ("own_key", "own_hash", "own_place", "first_key", "first_hash", "first_place", "number")
    own_key, own_hash, own_place, first_key, first_hash, first_place, number = (unused(taken, n) for n in names)
    firsts = firsts.select(F.col("first.doc_id").alias(first_key), F.col("first.text_hash").alias(first_hash)).distinct()
    firsts = firsts.withColumn(first_place, F.xxhash64(first_key, first_hash))
    own = documents.withColumns({own_key: F.col(f"`{key}`").cast("bigint"), own_hash: F.xxhash64(F.col(f"`{text}`"))})
    own = squeezed(own.withColumn(own_place, F.xxhash64(own_key, own_hash)), text)
    # One column deals the rows for the join and for the window, so texts move once; the others are compared after it.
    same_key = F.when(own[own_key].isNull(), firsts[first_key].isNull()).otherwise(own[own_key] == firsts[first_key])
    same = same_key & F.when(own[own_hash] == firsts[first_hash], True).otherwise(False)
    kept = own.join(firsts, (own[own_place] == firsts[first_place]) & same, "left_semi")
    once = Window.partitionBy(own_place, own_key, own_hash).orderBy(F.lit(0))
    kept = kept.withColumn(number, F.row_number().over(once)).where(F.col(number) == 1).drop(own_key, own_hash, own_place, number)
    return expanded(kept, text)


def unused(taken: set[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    while name in taken:
        name = f"_{name}"
    return name


def _run_stars(rows: DataFrame, percent: int, k: int | None = None) -> DataFrame:
    dealt = rows.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(freed(_stars(percent, k)), "a bigint, b bigint")


def _weights(sized: DataFrame) -> np.ndarray:
    """How common the words of each slot are, as a logarithm; ``SLOTS`` numbers at most go over the driver."""
    words = sized.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("words").alias("words")).toArrow()
    weights = np.zeros(SLOTS, np.int64)
    weights[words["slot"].to_numpy()] = np.rint(4 * np.log2(words["words"].to_numpy()))
    return weights


def _wanted_bits(classes: DataFrame) -> np.ndarray:
    """A bit for each hash of a text that is to be fetched, by its lowest bits; ``WANTED`` bits at most."""
    at = F.col("first_hash").bitwiseAND(F.lit(WANTED - 1))
    bit = F.expr("shiftleft(1L, cast(first_hash & 63 AS int))")
    words = classes.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(WANTED // 64, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint64)
