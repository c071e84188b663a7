"""Removal of every byte in a 100-byte string that also starts earlier, by sorting suffixes.

Only suffixes at anchors are sorted. The anchor of a string of ``LENGTH`` bytes is the first place
within it where the hash of ``GRAM`` bytes is smallest. It depends on the string alone, so equal
strings have their anchor at the same place, and an anchor serves a run of strings around it.

1. Each task finds the anchors of its texts: hash of the gram, hash of all bytes that the anchor's
   strings cover, document, place. Of anchors with equal bytes a task sends the earliest only; all
   others are repeated already. The rest meet by gram, packed into one row for each task and range
   of grams: anchors with the bytes of an earlier one are repeated, and where a gram stands in
   different bytes, the first of each kind goes on to be compared. Other anchors are done.
2. These decisions meet their texts. Repeated anchors give byte ranges, the others suffixes.
3. Suffixes are range-partitioned by their leading bytes, with splitters from a bounded sample.
   Each bucket sorts them by multikey quicksort, forwards from the anchor and backwards from it,
   and takes the longest common prefixes of neighbours. Two anchors share a string that begins
   ``o`` bytes before them exactly if they share ``LENGTH - o`` bytes forwards and ``o`` backwards,
   so both orders give the classes of equal strings for every ``o``. All of a class but the first
   are removed. Leading bytes that fill several buckets are dealt out over them; the first strings
   of each such bucket are then compared across the boundaries by the earliest of each class.
4. The removed byte ranges of a text are merged and cut out of it.

No group meets in one task: what shares a gram has a row for each task at most, or, beyond
``KINDS`` kinds of bytes in a task, goes straight to the buckets.

Texts are UTF-8 bytes. An occurrence is earlier if its (key, start) is smaller. Defined results:
NULL and empty texts have nothing to remove; rows with equal keys are ordered by start alone, so
equal rows do not remove each other; a NULL key comes before all others; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgauge.llm import textbuf
from termgauge.llm.grouping import groups
from termgauge.llm.memory import freed
from termgauge.session import materialise

LENGTH, GRAM = 100, 32
STEP = 1 << 14
KINDS = 64
ROWS = 30_000
SAMPLE = 300
PARTS_PER_TASK = 8
ORDER_BITS = np.uint64(21)
HIGH48 = np.uint64(16)
NO_KEY = -(1 << 63)


# ------------------------------------------------------------------ anchors


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from every place on."""
    h, width, factor = textbuf.RAW[data], 1, textbuf.BASE
    while width < gram:
        h = h[:-width] * factor + h[width:]
        factor = factor * factor
        width *= 2
    return textbuf.mix(h)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbouring keys."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Row, place, first and last start of the strings served, hash of the gram and of all bytes covered."""
    found = []
    for lo in range(0, max(0, len(data) - length + 1), STEP):
        part = data[lo : lo + STEP + length - 1]
        h = _gram_hashes(part, gram)
        keys = (h >> ORDER_BITS << ORDER_BITS) | np.arange(len(h), dtype=np.uint64)
        at = (_least(keys, length - gram + 1) & np.uint64((1 << 21) - 1)).astype(np.int64)
        start = np.arange(len(at)) + lo
        row = np.searchsorted(offsets, start, "right") - 1
        whole = start + length <= offsets[row + 1]
        start, row, at = start[whole], row[whole], at[whole]
        if not len(start):
            continue
        head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
        last = np.r_[head[1:], len(start)] - 1
        at, first, end = at[head], start[head] - lo, start[last] - lo + length
        found.append((row[head], at + lo, first + lo, end - length + lo, h[at], _cover(h, at, first, end, length, gram)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    row, at, first, last, h, cover = (np.concatenate(x) for x in zip(*found))
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])  # an anchor of two steps
    end = np.r_[head[1:], len(at)] - 1
    at, first, last, cover = at[head], first[head], last[end], cover[head]
    for i in np.flatnonzero(head != end):
        own = _gram_hashes(data[first[i] : last[i] + length], gram)
        stop = np.array([last[i] - first[i] + length])
        cover[i] = _cover(own, np.array([at[i] - first[i]]), np.array([0]), stop, length, gram)[0]
    return row[head], at, first, last, h[head], cover


def _cover(h: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Hash of the bytes from ``first`` to ``end``: the grams laid end to end, the last one, and the anchor's place."""
    cover = textbuf.mix((at - first).astype(np.uint64) ^ h[end - gram])
    for k in range((2 * length - gram) // gram):
        cover = textbuf.mix(cover * textbuf.BASE + h[np.minimum(first + k * gram, end - gram)])
    return cover


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns as planes of bytes, squeezed; high bytes that are the same cost nothing."""
    planes = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() if len(c) else b"" for c in columns]
    return struct.pack("<q", len(columns[0])) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    n = struct.unpack_from("<q", data)[0]
    flat, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


REPEATED, COMPARED, TEXT = 0, 1, 2
MET = ["<u8", "<u8", "<i8", "<u4", "u1"]  # steps between grams, cover, key, place, whether more kinds are known
KNOWN = ["<i8", "<u4", "<u8", "u1"]  # key, place, cover, decision


def _anchor_rows(parts: int):
    """A row (part, met, known) for each range of grams: anchors to meet others, and decided ones."""

    def run(batches):
        found = []
        for batch in batches:
            keys = batch.column(0).fill_null(NO_KEY).to_numpy()
            for lo, _, data, offsets in textbuf.chunks(batch.column(1)):
                row, at, _, _, h, cover = anchors(data, offsets)
                found.append((h >> HIGH48, cover >> HIGH48, keys[lo + row], (at - offsets[row]).astype(np.uint32)))
        if not found:
            return
        gram, cover, key, place = (np.concatenate(x) for x in zip(*found))
        del found
        order = np.lexsort((place, key, cover, gram))
        gram, cover, key, place = gram[order], cover[order], key[order], place[order]
        if not len(gram):
            return
        first = np.r_[True, (gram[1:] != gram[:-1]) | (cover[1:] != cover[:-1])]
        head = np.flatnonzero(first)
        owner = head[np.cumsum(first) - 1]
        later = (key != key[owner]) | (place != place[owner])  # equal rows of a document count once
        new = np.r_[True, gram[head][1:] != gram[head][:-1]]
        begins = np.flatnonzero(new)
        kinds = np.diff(begins, append=len(head))
        many = np.repeat(kinds > KINDS, kinds)
        sent = ~many | new
        known_at = np.concatenate([np.flatnonzero(later), head[many]])
        decision = np.concatenate([np.full(int(later.sum()), REPEATED), np.full(int(many.sum()), COMPARED)]).astype(np.uint8)
        width = np.uint64(-(-(1 << 48) // parts))
        met_at, met_many = head[sent], many[sent].astype(np.uint8)
        met_part, known_part = gram[met_at] // width, gram[known_at] // width
        by_part = np.argsort(known_part, kind="stable")
        known_at, known_part, decision = known_at[by_part], known_part[by_part], decision[by_part]
        out = []
        for part in range(parts):
            a, b = np.searchsorted(met_part, [part, part + 1])
            c, d = np.searchsorted(known_part, [part, part + 1])
            if a == b and c == d:
                continue
            m, k = met_at[a:b], known_at[c:d]
            steps = np.diff(gram[m], prepend=np.uint64(0))
            met = _pack([steps, cover[m], key[m], place[m], met_many[a:b]])
            out.append((part, met, _pack([key[k], place[k], cover[k], decision[c:d]])))
            if len(out) == 64:
                yield _part_rows(out)
                out = []
        if out:
            yield _part_rows(out)

    return run


def _part_rows(rows):
    kinds = [pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["part", "met", "known"])


DECISION = "doc_id bigint, kind int, place int, cover bigint, doc bigint, packed binary"
DECISION_NAMES = [x.split()[0] for x in DECISION.split(", ")]


def _decide(batches):
    """From rows sorted by part: a decision for every anchor that is repeated or must be compared."""
    for table in groups(batches, 1):
        rows = [_unpack(x.as_py(), MET) for x in table.column(1)]
        gram = np.concatenate([np.cumsum(r[0], dtype=np.uint64) for r in rows])
        cover, key, place, many = (np.concatenate([r[i] for r in rows]) for i in (1, 2, 3, 4))
        order = np.lexsort((place, key, cover, gram))
        gram, cover, key, place, many = gram[order], cover[order], key[order], place[order], many[order]
        out = [_unpack(x.as_py(), KNOWN) for x in table.column(2)]
        if len(gram):
            first = np.r_[True, (gram[1:] != gram[:-1]) | (cover[1:] != cover[:-1])]
            owner = np.flatnonzero(first)[np.cumsum(first) - 1]
            later = (key != key[owner]) | (place != place[owner])
            begins = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            sizes = np.diff(begins, append=len(gram))
            kinds = np.add.reduceat(first.astype(np.int64), begins) + KINDS * np.add.reduceat(many.astype(np.int64), begins)
            compared = np.repeat(kinds > 1, sizes) & ~later
            for at, decision in ((later, REPEATED), (compared, COMPARED)):
                out.append([key[at], place[at], cover[at], np.full(int(at.sum()), decision, np.uint8)])
        key, place, cover, decision = (np.concatenate(x) for x in zip(*out))
        for lo in range(0, len(key), 1 << 16):
            own = slice(lo, lo + (1 << 16))
            n = len(key[own])
            columns = [pa.array(key[own]), pa.array(decision[own].astype(np.int32)), pa.array(place[own].astype(np.int32))]
            columns += [pa.array(cover[own].view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, DECISION_NAMES)


def _packed(batches):
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            n = part.num_rows
            texts = [squeeze((t or "").encode()) for t in part.column(2).to_pylist()]
            columns = [part.column(0).fill_null(NO_KEY), pa.array(np.full(n, TEXT, np.int32)), pa.nulls(n, pa.int32())]
            columns += [pa.nulls(n, pa.int64()), part.column(1), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, DECISION_NAMES)


# ------------------------------------------------------------------ suffixes


SUFFIX = "bucket int, hot boolean, key bigint, doc_id bigint, doc bigint, place bigint, stop bigint, back int, bytes binary"
SUFFIX_NAMES = [x.split()[0] for x in SUFFIX.split(", ")]


def _leads(batches):
    """The leading bytes of the anchors of a text, as a number that sorts like them."""
    for batch in batches:
        for _, _, data, offsets in textbuf.chunks(batch.column(0)):
            _, at, _, _, _, _ = anchors(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(_lead(data, at) >> np.uint64(1)).cast(pa.int64())], ["lead"])


def _lead(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    lead = np.zeros(len(at), np.uint64)
    for k in range(8):
        lead = (lead << np.uint64(8)) | data[at + k].astype(np.uint64)
    return lead


def _suffixes(splitters: np.ndarray):
    """From decisions and then texts of each document: byte ranges of repeated anchors, and suffixes to compare."""

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        here, kept, rows, size = None, [], [], 0
        for batch in batches:
            ids, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            place = batch.column(2).fill_null(0).to_numpy().astype(np.int64)
            cover = batch.column(3).fill_null(0).to_numpy()
            for run_of in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
                if not len(run_of):
                    continue
                if ids[run_of[0]] != here:
                    here, kept = int(ids[run_of[0]]), []
                at = run_of[kind[run_of] != TEXT]
                if len(at):
                    kept.append((place[at], cover[at], kind[at]))
                if not kept:
                    continue
                for i in run_of[kind[run_of] == TEXT].tolist():
                    found = _of_text(expand(batch.column(5)[i].as_py()), kept, here, batch.column(4)[i].as_py(), splitters)
                    size += sum(len(r[-1] or b"") for r in found)
                    rows += found
                    if len(rows) > 10_000 or size > 1 << 23:
                        yield _suffix_rows(rows)
                        rows, size = [], 0
        if rows:
            yield _suffix_rows(rows)

    return run


def _of_text(text: bytes, kept: list, doc_id: int, doc: int, splitters: np.ndarray) -> list[tuple]:
    data = np.frombuffer(text, np.uint8)
    _, at, first, last, h, cover = anchors(data, np.array([0, len(data)]))
    place, covers, kind = (np.concatenate(x) for x in zip(*kept))
    if not len(at):
        return []
    where = np.minimum(np.searchsorted(at, place), len(at) - 1)
    same = (at[where] == place) & ((cover[where] >> HIGH48).view(np.int64) == covers)
    where, kind = where[same], kind[same]
    gone = np.unique(where[kind == REPEATED])
    out = [
        (doc % 4096, False, None, doc_id, doc, b, e, None, None)
        for b, e in merged(first[gone], last[gone] + LENGTH)
    ]
    some = np.setdiff1d(where[kind == COMPARED], gone)
    lead = _lead(data, at[some]) >> np.uint64(1)
    low, high = np.searchsorted(splitters, lead, "left"), np.searchsorted(splitters, lead, "right")
    hot = high - low > 1
    spread = np.where(hot, low + 1 + (doc % (1 << 30)) % np.maximum(high - low, 1), high)
    for i, bucket, is_hot in zip(some.tolist(), spread.tolist(), hot.tolist()):
        a, s, e = int(at[i]), int(first[i]), int(last[i]) + LENGTH
        out.append((bucket, is_hot, int(h[i].view(np.int64)), doc_id, doc, a, None, a - s, text[s:e]))
    return out


def _suffix_rows(rows):
    kinds = [pa.int32(), pa.bool_(), *[pa.int64()] * 5, pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], SUFFIX_NAMES)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of ``words``, compared word by word.

    Rows are parted into less, equal and more by the word at the current depth; the equal ones go
    on with the next word. Parts of up to 512 rows are sorted at once.
    """
    order, stack = np.arange(len(words)), [(0, len(words), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        own = order[lo:hi]
        if hi - lo <= 512:
            order[lo:hi] = own[np.lexsort(words[own, depth:].T[::-1])]
            continue
        value = words[own, depth]
        pivot = np.sort(value[[0, (hi - lo) // 2, -1]])[1]
        less, more = value < pivot, value > pivot
        equal = ~(less | more)
        a, b = lo + int(less.sum()), hi - int(more.sum())
        order[lo:hi] = np.concatenate([own[less], own[equal], own[more]])
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _common(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of the order has in common with the one before it, without the first word."""
    same = words[order][1:] ^ words[order][:-1]
    first = np.argmax(same != 0, axis=1)
    value = same[np.arange(len(same)), first]
    lead = sum((value < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
    common = (first - 1) * 8 + lead
    common[first == 0] = -1
    common[value == 0] = (words.shape[1] - 1) * 8
    return np.r_[-1, common]


def _matrix(values: list[bytes], group: np.ndarray, width: int) -> np.ndarray:
    """Rows of big-endian words: the group, then the bytes, filled up with zeros."""
    padded = np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), ">u8").reshape(len(values), width // 8)
    return np.column_stack([group.astype(np.uint64), padded.astype(np.uint64)])


def repeated(group, back, ahead, values: list[bytes], rank, hot):
    """Row, begin and end, relative to the anchor, of all strings of a group with an earlier equal.

    The rows of a group come in the order of ``rank``. Also row and distance of the strings of hot
    rows that are the first of their class.
    """
    n, places = len(group), LENGTH - GRAM + 1
    forth = _matrix([v[b:] for v, b in zip(values, back.tolist())], group, 104)
    behind = _matrix([v[:b][::-1] for v, b in zip(values, back.tolist())], group, 72)
    one, two = multikey_quicksort(forth), multikey_quicksort(behind)
    with_next, with_prev = _common(forth, one), _common(behind, two)
    later = np.zeros((n, places + 1), np.int8)
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    nearest = LENGTH - ahead  # the smallest distance that the anchor serves; the largest is back
    firsts = []
    for o in range(places):
        own = np.flatnonzero((nearest <= o) & (o <= back))
        if not len(own):
            continue
        right[one] = np.cumsum(with_next < LENGTH - o)
        left[two] = np.cumsum(with_prev < o)
        classes = right[own] * (n + 1) + left[own]
        _, first, at = np.unique(classes, return_index=True, return_inverse=True)
        hit = rank[own] > rank[own[first]][at]
        later[own[hit], o] = 1
        if hot.any():
            firsts += [(int(i), o) for i in own[~hit & hot[own]]]
    edge = np.diff(later, axis=1, prepend=np.int8(0))
    row, o_first = np.nonzero(edge == 1)
    _, o_end = np.nonzero(edge == -1)
    return row, -(o_end - 1), LENGTH - o_first, firsts


REMOVED = "doc bigint, begin bigint, stop bigint, string bigint, doc_id bigint"
REMOVED_NAMES = [x.split()[0] for x in REMOVED.split(", ")]


def _removed(doc, begin, stop, string=None, doc_id=None):
    n = len(doc)
    more = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (string, doc_id)]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, begin, stop)), *more], REMOVED_NAMES)


def _resolve(batches):
    """From suffixes sorted by bucket and key: byte ranges that earlier strings repeat, and first strings of hot ones."""

    def run(table):
        key, ids = table.column(2).to_numpy(), table.column(3).to_numpy()
        place = table.column(5).to_numpy()
        bucket = table.column(0).to_numpy()
        order = np.lexsort((place, ids, key, bucket))
        table = table.take(pa.array(order))
        bucket, key, ids, place = bucket[order], key[order], ids[order], place[order]
        doc, hot = table.column(4).to_numpy(), table.column(1).to_numpy(zero_copy_only=False)
        back = table.column(7).to_numpy().astype(np.int64)
        values = table.column(8).to_pylist()
        ahead = np.array([len(v) for v in values]) - back
        change = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        group = np.cumsum(np.r_[0, change])
        rank = np.cumsum(np.r_[0, change | (ids[1:] != ids[:-1]) | (place[1:] != place[:-1])])
        row, begin, stop, firsts = repeated(group, back, ahead, values, rank, hot)
        yield _removed(doc[row], place[row] + begin, place[row] + stop)
        for lo in range(0, len(firsts), 50_000):
            part = firsts[lo : lo + 50_000]
            at = np.array([i for i, _ in part])
            start = place[at] - np.array([o for _, o in part])
            strings = [values[i][b - o : b - o + LENGTH] for (i, o), b in zip(part, back[at].tolist())]
            marks = np.array([xxhash.xxh3_64_intdigest(x) for x in strings], np.uint64).view(np.int64)
            yield _removed(doc[at], start, start + LENGTH, marks, ids[at])

    kept, size = [], 0
    for batch in batches:
        ranges = batch.filter(batch.column(8).is_null())
        if ranges.num_rows:
            yield _removed(ranges.column(4), ranges.column(5), ranges.column(6))
        batch = batch.filter(batch.column(8).is_valid())
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += batch.num_rows
        if size < ROWS:
            continue
        # Everything before the last group can be worked on; the last one may go on.
        table = pa.Table.from_batches(kept).combine_chunks()
        key, bucket = table.column(2).to_numpy(), table.column(0).to_numpy()
        change = np.flatnonzero((key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1]))
        if len(change):
            cut = int(change[-1]) + 1
            yield from run(table.slice(0, cut))
            kept, size = table.slice(cut).to_batches(), table.num_rows - cut
        else:
            kept = table.to_batches()
    if kept:
        yield from run(pa.Table.from_batches(kept))


# ------------------------------------------------------------------ texts


def merged(begin: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Ranges put together where they overlap or touch."""
    out: list[list[int]] = []
    for b, s in sorted(zip(begin.tolist(), stop.tolist())):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s)
        else:
            out.append([b, s])
    return [(b, s) for b, s in out]


CUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _cut(keep: list[str], as_text: bool):
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string() if as_text else pa.binary()]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch, rows = whole.slice(lo, 1000), []
                for doc_id, text, ranges in zip(*(batch.column(i) for i in range(3))):
                    text = (text.as_py() or "").encode()
                    gone = []
                    if ranges.is_valid:
                        own = ranges.values
                        gone = merged(own.field(0).to_numpy(), own.field(1).to_numpy())
                    kept, at = [], 0
                    for b, s in gone:
                        kept.append(text[at:b])
                        at = s
                    left = b"".join([*kept, text[at:]])
                    removed = sum(s - b for b, s in gone)
                    mark = hashlib.sha256(left).hexdigest()
                    result = left.decode(errors="ignore") if as_text else left
                    rows.append((doc_id.as_py(), len(text), removed, len(gone), mark, result))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*columns, *batch.columns[3:]], [*CUT, *keep])

    return run


def splitters(texts: DataFrame, parts: int, sample: int = SAMPLE) -> np.ndarray:
    """Leading bytes that cut the anchors of ``sample`` texts, those with the smallest hash, into equal parts."""
    some = texts.orderBy(F.xxhash64("text")).limit(sample).select("text")
    leads = np.sort([r.lead for r in some.mapInArrow(freed(_leads), "lead bigint").collect()])
    if not len(leads):
        return np.zeros(0, np.uint64)
    return leads[[len(leads) * i // parts for i in range(1, parts)]].astype(np.uint64)


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """doc, ranges of every document with something to remove; ``rows`` has doc_id, text, doc."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.select("doc_id", "text").mapInArrow(freed(_anchor_rows(tasks * PARTS_PER_TASK)), "part int, met binary, known binary")
    decided = met.repartition("part").sortWithinPartitions("part").mapInArrow(freed(_decide), DECISION)
    packed = rows.select("doc_id", "doc", "text").mapInArrow(freed(_packed), DECISION)
    by_doc = decided.unionByName(packed).repartition("doc_id").sortWithinPartitions("doc_id", "kind")
    cuts = splitters(rows, tasks * 2)
    suffixes = by_doc.mapInArrow(freed(_suffixes(cuts)), SUFFIX)
    dealt = suffixes.repartition("bucket").sortWithinPartitions("bucket", "key")
    found = materialise(dealt.mapInArrow(freed(_resolve), REMOVED), "suffix-ranges")

    own = found.where("string IS NULL").select("doc", "begin", "stop")
    # First strings of buckets that share leading bytes: the earliest of each stays.
    strings = found.where("string IS NOT NULL")
    least = strings.groupBy("string").agg(F.min(F.struct("doc_id", "begin")).alias("least"))
    again = strings.join(least, "string").where(F.struct("doc_id", "begin") > F.col("least"))
    ranges = own.unionByName(again.select("doc", "begin", "stop"))
    return ranges.groupBy("doc").agg(F.collect_set(F.struct("begin", "stop")).alias("ranges"))


def remove_repeated(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    as_text: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) for every row.

    With ``as_text``, kept is a string without characters that a cut has parted. The columns ``keep`` of the input follow, under their names with ``given_`` before.
    """
    keep = keep or []
    others = [F.col(f"`{c}`").alias(f"given_{c}") for c in keep]
    rows = documents.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), *others
    )
    rows = rows.withColumn("doc", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(rows.select("doc_id", "text", "doc"))
    given = [f"given_{c}" for c in keep]
    joined = rows.join(ranges, "doc", "left").select("doc_id", "text", "ranges", *given)
    numbers = ["doc_id", "n_bytes", "n_removed", "n_spans"]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in numbers])
    schema = schema.add("kept_sha256", T.StringType()).add("kept", T.StringType() if as_text else T.BinaryType())
    for c in keep:
        schema = schema.add(f"given_{c}", documents.schema[c].dataType)
    return joined.mapInArrow(freed(_cut(given, as_text)), schema)


def without_repeated(documents: DataFrame, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``documents`` with the repeated bytes cut out of the text, and without texts of which nothing is left.

    Characters that a cut would leave in part go as a whole. ``chars``, if there, is counted anew.
    """
    cut = remove_repeated(documents, key, text, documents.columns, as_text=True)
    cut = cut.where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    whole = F.col("n_removed") == 0
    changed = {text: F.when(whole, F.col(f"`given_{text}`")).otherwise(F.col("kept"))}
    if chars in documents.columns:
        changed[chars] = F.when(whole, F.col(f"`given_{chars}`")).otherwise(F.length("kept"))
    kinds = {f.name: f.dataType for f in documents.schema}
    return cut.select(*[changed.get(c, F.col(f"`given_{c}`")).cast(kinds[c]).alias(c) for c in documents.columns])
