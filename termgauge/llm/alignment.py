"""Token alignment of two tokenizers by sparse incidence products.

A text, with a blank before it, is encoded by a byte-level BPE (A) and by a sentencepiece model (B, which
adds that blank itself). Both tile the same bytes. Incidence matrices of tokens and bytes are kept in
compressed rows (``Csr``) and multiplied row by row after Gustavson: the entries of ``A B^T`` are the pairs
of tokens that share bytes, with the number of shared bytes. Pairs whose ranges end together end a group;
the product of the matrices of tokens and groups gives the pairs that share a group, and stays factored
(group number of each token) unless asked for, because its size is a product within a group.

Texts are laid side by side on one axis of bytes, a megabyte at a time. They are cut before, at single blanks
that no token of either tokenizer spans: both end a token there, so no group is cut, and the matrices of a text
are made of blocks, one for each word. ``align`` returns long texts in segments; ``alignment_summary`` aligns
every word that a task has not met before, once, and puts texts together from their words.

Corpus-wide counts of linked ids take two passes. Pass one writes a text as places in the list of words of its
block (the rows of a task, up to a number of words), and for each block the pairs that its words link, with
their counts. These are summed over blocks, ranked within each id of B, and joined back to the blocks; pass
two sums them by words and texts. What is shuffled are the distinct pairs of blocks and the words of texts as
four bytes each, and a frequent pair has one row for each block.

Defined results: a NULL or empty text, and one whose tokens do not spell it, has no tokens and zeros;
repeated rows and repeated or NULL keys are aligned like any other row; equal counts are all the highest;
an empty table gives no rows; a text without single blanks is aligned as a whole, whatever its length, and the
words of one text are counted in one row, whatever their number;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgauge.llm.packing import byte_letters
from termgauge.llm.token_counts import SINGLE_BLANK, JsonCounter, PieceCounter, byte_slices, text_sizes
from termgauge.session import new_path

SEGMENT_CHARS = 1 << 16
BATCH_BYTES = 1 << 20
BLOCK_WORDS = 1 << 21
KEPT = 300_000  # words that a task keeps from one block to the next
JOINED_BYTES = 1 << 14  # of words encoded as one text
SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
ODD_BLANK = re.compile(r"(?:^|\s) | (?:\s|$)")


# ---------------------------------------------------------------- sparse matrices


class Csr(NamedTuple):
    """Compressed sparse rows: ``indices[indptr[i]:indptr[i + 1]]`` are the columns of row i, ascending."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def csr(rows: np.ndarray, columns: np.ndarray, data: np.ndarray, height: int, width: int) -> Csr:
    """From entries in the order of their rows."""
    indptr = np.zeros(height + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=height), out=indptr[1:])
    return Csr(indptr, columns, data, width)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    return csr(m.indices[order], m.rows[order], m.data[order], m.width, len(m.indptr) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """``a b``: row i sums the rows of b that row i of a names, weighted (Gustavson)."""
    starts, sizes = b.indptr[:-1][a.indices], np.diff(b.indptr)[a.indices]
    ends = np.cumsum(sizes)
    source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
    rows, columns = np.repeat(a.rows, sizes), b.indices[source]
    values = np.repeat(a.data, sizes) * b.data[source]
    place = rows * b.width + columns
    if len(place) and (np.diff(place) < 0).any():
        order = np.argsort(place, kind="stable")
        place, values = place[order], values[order]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    summed = np.add.reduceat(values, first) if len(first) else values
    at = place[first]
    return csr(at // max(b.width, 1), at % max(b.width, 1), summed, len(a.indptr) - 1, b.width)


def token_bytes(lengths: np.ndarray) -> Csr:
    """Tokens that tile an axis of bytes: row i has the bytes of token i."""
    indptr = np.concatenate([[0], np.cumsum(lengths)])
    n = int(indptr[-1])
    return Csr(indptr, np.arange(n), np.ones(n, np.int32), n)


def token_groups(groups: np.ndarray, n_groups: int) -> Csr:
    """Row i has the group of token i."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), n_groups)


class Aligned(NamedTuple):
    """Tokens of two tilings of the same bytes: links (i of A, j of B) that share ``overlap`` bytes, which
    of them end together, and the group of each token."""

    i: np.ndarray
    j: np.ndarray
    overlap: np.ndarray
    together: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: int


def align_lengths(a: np.ndarray, b: np.ndarray) -> Aligned:
    """Align tokens given by their lengths in bytes, none of them 0."""
    links = product(token_bytes(a), transposed(token_bytes(b)))
    i, j = links.rows, links.indices
    end_a, end_b = np.cumsum(a), np.cumsum(b)
    together = end_a[i] == end_b[j]
    closing = end_a[i[together]]
    return Aligned(i, j, links.data, together, np.searchsorted(closing, end_a), np.searchsorted(closing, end_b), len(closing))


def group_links(aligned: Aligned) -> Csr:
    """Pairs of tokens that share a group: as many as the product of both sides' tokens in each group."""
    own, other = token_groups(aligned.group_a, aligned.n_groups), token_groups(aligned.group_b, aligned.n_groups)
    return product(own, transposed(other))


# ---------------------------------------------------------------- tokenizers


class Pair:
    """Both tokenizers, the bytes of their tokens, and the digits of their ids with what follows them."""

    _open: dict[tuple[str, str], Pair] = {}

    def __init__(self, a: str, b: str):
        own, other = JsonCounter(a), PieceCounter(b)
        #: Whether no token of either spans a single blank.
        self.cuts = own.boundary is not None and other.boundary is SINGLE_BLANK
        self.a, self.b = own.tokenizer, other.model
        self.a.encode_special_tokens = True
        letters = {chr(c): v for v, c in byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in added else bytes(letters[c] for c in token)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        written = [f"{i}{after}".encode() for own, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for after in ends for i in range(len(own))]
        self.written = np.array(written, object)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self.b.is_control(i) else piece.replace("▁", " ").encode()

    @classmethod
    def of(cls, a: str, b: str) -> Pair:
        if (a, b) not in cls._open:
            cls._open[a, b] = cls(a, b)
        return cls._open[a, b]

    def encoded(self, segments: list[str]):
        """Ids of all segments by A and by B, and how many each segment has.

        Segments that neither begin nor end with white space are encoded many at a time, joined by blanks;
        where the tokens do not end with the segments, each is encoded by itself.
        """
        runs, size = [], JOINED_BYTES
        for k, s in enumerate(segments):
            joins = self.cuts and bool(s) and not s[0].isspace() and not s[-1].isspace() and "▁" not in s
            if joins and size < JOINED_BYTES:
                runs[-1][1] = k + 1
                size += len(s) + 1
            else:
                runs.append([k, k + 1])
                size = len(s) if joins else JOINED_BYTES
        joined = [" ".join(segments[lo:hi]) for lo, hi in runs]
        ends = [np.cumsum([len(s.encode()) + 1 for s in segments[lo:hi]]) for lo, hi in runs]
        out = []
        for encode, lengths in ((self._encode_a, self.length_a), (self._encode_b, self.length_b)):
            ids, n = [], []
            for (lo, hi), whole, own in zip(runs, ends, encode(joined)):
                found = np.array(own, np.int64)
                if hi - lo == 1:
                    n.append([len(found)])
                elif (last := last_tokens(lengths[found], whole)) is not None:
                    n.append(np.diff(last + 1, prepend=0))
                else:
                    single = encode(segments[lo:hi])
                    found = np.array([i for x in single for i in x], np.int64)
                    n.append([len(x) for x in single])
                ids.append(found)
            out.append((np.concatenate(ids) if ids else np.zeros(0, np.int64), np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)))
        (ids_a, n_a), (ids_b, n_b) = out
        return ids_a, ids_b, n_a, n_b

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def spelled(self, segments: list[bytes], ids_a, ids_b, n_a, n_b) -> np.ndarray:
        """Whether both token rows of each segment spell it."""
        whole = b"".join(segments)
        sizes = np.array([len(s) for s in segments], np.int64)
        good = np.ones(len(segments), bool)
        for ids, n, table, lengths in ((ids_a, n_a, self.bytes_a, self.length_a), (ids_b, n_b, self.bytes_b, self.length_b)):
            spelt = b"".join(map(table.__getitem__, ids.tolist()))
            own = summed_by(lengths[ids], n)
            if spelt == whole and (own == sizes).all():
                continue
            at = np.concatenate([[0], np.cumsum(own)]).tolist()
            good &= [spelt[at[k] : at[k + 1]] == s for k, s in enumerate(segments)]
        return good


def last_tokens(lengths: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
    """The token that ends at each of ``ends``; None if one ends elsewhere or tokens go on."""
    at = np.cumsum(lengths)
    if not len(at) or at[-1] != ends[-1]:
        return None
    found = np.searchsorted(at, ends)
    return found if (at[found] == ends).all() else None


def summed_by(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``n`` values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def words_of(text: str, cuts: bool = True) -> list[str]:
    """The text cut at all single blanks."""
    if not text or not cuts:
        return [text] if text else []
    return SAFE_BLANK.split(text) if ODD_BLANK.search(text) else text.split(" ")


def segments_of(text: str, size: int, cuts: bool = True) -> list[str]:
    """The text cut at single blanks, which are left out."""
    found, start = [], 0
    while cuts and len(text) - start > size and (cut := SAFE_BLANK.search(text, start + size)):
        found.append(text[start : cut.start()])
        start = cut.end()
    return [*found, text[start:]] if text else []


class Segment(NamedTuple):
    """A text's tokens, or a long text's from one cut to the next: ids, groups, links."""

    row: int
    ids_a: np.ndarray
    ids_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_groups: int
    i: np.ndarray
    j: np.ndarray
    overlap: np.ndarray
    together: np.ndarray


def aligned_segments(texts: list[str], pair: Pair, segment_chars: int, batch_bytes: int):
    """Segments of the texts, in order; none of a text whose tokens do not spell it."""
    cut = [segments_of(t, segment_chars, pair.cuts) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    flat = [s for c in cut for s in c]
    spelt = [b" " + s.encode() for s in flat]
    weight = np.cumsum([len(s) for s in spelt]) // batch_bytes
    parts = np.flatnonzero(np.diff(weight, prepend=-1, append=-1)).tolist() if flat else []
    encoded = []
    good = np.ones(len(texts), bool)
    for lo, hi in zip(parts[:-1], parts[1:]):
        ids = pair.encoded(flat[lo:hi])
        encoded.append((lo, hi, ids))
        np.logical_and.at(good, owner[lo:hi], pair.spelled(spelt[lo:hi], *ids))
    for lo, hi, (ids_a, ids_b, n_a, n_b) in encoded:
        kept = good[owner[lo:hi]]
        if not kept.all():
            ids_a, ids_b = ids_a[np.repeat(kept, n_a)], ids_b[np.repeat(kept, n_b)]
            n_a, n_b = n_a[kept], n_b[kept]
        if kept.any():
            yield from _cut(owner[lo:hi][kept].tolist(), ids_a, ids_b, n_a, n_b, pair)


def _written(found: Aligned, ids_a, ids_b, pair: Pair) -> list[bytes]:
    """Both sides' ids as they stand in "a,a|b;a|b,b;": behind the tokens of the other side that come before."""
    last_a = np.append(np.diff(found.group_a) > 0, True)
    last_b = np.append(np.diff(found.group_b) > 0, True)
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.searchsorted(found.group_b, found.group_a, "left")] = ids_a + last_a * len(pair.bytes_a)
    at_b = np.arange(len(ids_b)) + np.searchsorted(found.group_a, found.group_b, "right")
    order[at_b] = ids_b + last_b * len(pair.bytes_b) + 2 * len(pair.bytes_a)
    return pair.written[order].tolist()


def _cut(owner: list[int], ids_a, ids_b, n_a, n_b, pair: Pair):
    found = align_lengths(pair.length_a[ids_a], pair.length_b[ids_b])
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    link = np.searchsorted(found.i, np.concatenate([[0], end_a])).tolist()
    groups = np.concatenate([[0], found.group_a[end_a - 1] + 1]).tolist()
    from_a, from_b = [0, *end_a.tolist()], [0, *end_b.tolist()]
    for k, row in enumerate(owner):
        a0, a1, b0, b1 = from_a[k], from_a[k + 1], from_b[k], from_b[k + 1]
        own = slice(link[k], link[k + 1])
        yield Segment(
            row,
            ids_a[a0:a1],
            ids_b[b0:b1],
            found.group_a[a0:a1] - groups[k],
            found.group_b[b0:b1] - groups[k],
            groups[k + 1] - groups[k],
            found.i[own] - a0,
            found.j[own] - b0,
            found.overlap[own],
            found.together[own],
        )


# ---------------------------------------------------------------- operators


def _chosen(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))


def align(
    documents: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", segment_chars: int = SEGMENT_CHARS, batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """doc_id, segment, a_ids, b_ids, a_groups, b_groups, links of every text that its tokens spell.

    A long text has several segments, numbered from 0. ``a_groups`` and ``b_groups`` hold the group of each
    token within the segment: tokens of both sides with the same number share a group. ``links`` are the
    pairs that share bytes: ``a, b`` (places in the ids), ``overlap`` (bytes), ``together`` (ranges end together).
    """
    link = T.StructType(
        [T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]
        + [T.StructField("overlap", T.IntegerType()), T.StructField("together", T.BooleanType())]
    )
    lists = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("a_ids", "b_ids", "a_groups", "b_groups")]
    schema = T.StructType(
        [T.StructField("doc_id", documents.schema[key].dataType), T.StructField("segment", T.IntegerType()), *lists]
        + [T.StructField("links", T.ArrayType(link))]
    )
    kinds = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("overlap", pa.int32()), ("together", pa.bool_())]))

    def run(batches):
        pair = Pair.of(a, b)
        for batch in batches:
            for part, _ in byte_slices(batch, text_sizes(batch.column(1)), batch_bytes):
                before, number = None, 0
                for s in aligned_segments([t or "" for t in part.column(1).to_pylist()], pair, segment_chars, batch_bytes):
                    number = number + 1 if s.row == before else 0
                    before = s.row
                    own = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (s.ids_a, s.ids_b, s.group_a, s.group_b)]
                    fields = [pa.array(x.astype(np.int32)) for x in (s.i, s.j, s.overlap)] + [pa.array(s.together)]
                    pairs = pa.StructArray.from_arrays(fields, ["a", "b", "overlap", "together"])
                    links = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pairs).cast(kinds)
                    columns = [part.column(0).slice(s.row, 1), pa.array([number], pa.int32()), *own, links]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _chosen(documents, key, text).mapInArrow(run, schema)


class Words:
    """Words met so far: numbers of tokens, groups and links, whether spelled, linked ids, groups as bytes."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.place: dict[str, int] = {}
        self.written: list[bytes] = []
        self.numbers = np.zeros((1024, 5), np.int64)
        self.links: list[np.ndarray] = []  # codes of linked ids of the words in order, in parts

    def learn(self, texts: list[list[str]], batch_bytes: int):
        """Align the words that are new."""
        place, new = self.place, []
        for words in texts:
            for word in set(words).difference(place):
                place[word] = len(place)
                new.append(word)
        sizes = np.cumsum([len(w) for w in new]) // batch_bytes
        parts = np.flatnonzero(np.diff(sizes, prepend=-1, append=-1)).tolist() if new else []
        for lo, hi in zip(parts[:-1], parts[1:]):
            self._add(new[lo:hi])

    def _add(self, new: list[str]):
        pair, start = self.pair, len(self.written)
        ids_a, ids_b, n_a, n_b = pair.encoded(new)
        good = pair.spelled([b" " + w.encode() for w in new], ids_a, ids_b, n_a, n_b)
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        found = align_lengths(pair.length_a[ids_a], pair.length_b[ids_b])
        i, j = found.i[found.together], found.j[found.together]
        self.links.append(ids_a[i] * len(pair.bytes_b) + ids_b[j])
        end_a, ends = np.cumsum(n_a), np.cumsum(n_a + n_b)
        n_links = np.diff(np.searchsorted(i, end_a), prepend=0)
        n_groups = np.diff(np.concatenate([[0], found.group_a + 1])[end_a], prepend=0)
        tokens, ends = _written(found, ids_a, ids_b, pair), ends.tolist()
        self.written += [b"".join(tokens[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends)]
        if len(self.written) > len(self.numbers):
            room = np.zeros((max(len(self.written), 2 * len(self.numbers)), 5), np.int64)
            room[:start] = self.numbers[:start]
            self.numbers = room
        self.numbers[start : len(self.written)] = np.stack([n_a, n_b, n_groups, n_links, good], axis=1)

    def linked(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the linked ids of some words, one after the other, and how many each has."""
        n = self.numbers[: len(self.written), 3]
        starts = np.cumsum(n) - n
        codes = np.concatenate(self.links)
        self.links = [codes]
        sizes = n[chosen]
        ends = np.cumsum(sizes)
        return codes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[chosen] - ends + sizes, sizes)], sizes


COUNTED = ("n_a", "n_b", "n_groups", "n_links")
LISTED = ("words", "pairs", "pair_links", "word_pairs", "word_sizes")


class _Block:
    """Texts as places of their words."""

    def __init__(self):
        self.keys, self.rows, self.texts, self.words = [], [], [], 0

    def add(self, keys: pa.Array, texts: list[list[str]], known: Words):
        self.keys.append(keys)
        for words in texts:
            places = list(map(known.place.__getitem__, words))
            at = np.array(places, np.int64)
            own = known.numbers[at].sum(axis=0).tolist()
            if own[4] < len(places):
                own, at, places = [0] * 5, at[:0], []
            digest = hashlib.sha256(b"".join(map(known.written.__getitem__, places))[:-1]).hexdigest() if places else ""
            self.rows.append((*own[:4], digest))
            self.texts.append(at)
            self.words += len(places)

    def batches(self, number: int, known: Words, names: list[str], kind: pa.DataType):
        """The texts with places among the block's own words, and a row with the pairs that these link."""
        chosen, places = np.unique(np.concatenate(self.texts), return_inverse=True)
        times = np.bincount(places, minlength=len(chosen))
        codes, sizes = known.linked(chosen)
        pairs, where = np.unique(codes, return_inverse=True)
        counts = np.bincount(where, np.repeat(times, sizes), len(pairs)).astype(np.int64)
        keys, at = pa.concat_arrays(self.keys), 0
        for lo in range(0, len(self.rows), 500):
            some, texts = self.rows[lo : lo + 500], []
            for own in self.texts[lo : lo + 500]:
                texts.append(places[at : at + len(own)].astype("<u4").tobytes())
                at += len(own)
            columns = [pa.array([number] * len(some), pa.int64()), keys.slice(lo, len(some))]
            columns += [pa.array([r[k] for r in some], pa.int64()) for k in range(4)]
            columns += [pa.array([r[4] for r in some], pa.string()), pa.array(texts, pa.binary())]
            columns += [pa.nulls(len(some), pa.binary())] * 4
            yield pa.RecordBatch.from_arrays(columns, names=names)
        lists = (pairs, counts, where.astype("<u4"), sizes.astype("<u4"))
        columns = [pa.array([number], pa.int64()), pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 4]
        columns += [pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
        columns += [pa.array([x.tobytes()], pa.binary()) for x in lists]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _aligner(a: str, b: str, batch_bytes: int, block_words: int, kept: int, names: list[str], kind: pa.DataType):
    def run(batches):
        from pyspark import TaskContext

        known, block = Words(Pair.of(a, b)), _Block()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, _ in byte_slices(batch, text_sizes(batch.column(1)), batch_bytes):
                texts = [words_of(t or "", known.pair.cuts) for t in part.column(1).to_pylist()]
                known.learn(texts, batch_bytes)
                block.add(part.column(0), texts, known)
                if block.words >= block_words:
                    yield from block.batches(number, known, names, kind)
                    block, number = _Block(), number + 1
                    known = Words(known.pair) if len(known.place) > kept else known
        if block.rows:
            yield from block.batches(number, known, names, kind)

    return run


def pair_counts(blocks: DataFrame) -> DataFrame:
    """block, place, pair, n: the distinct pairs of every block with their number of links there."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                codes = np.frombuffer(batch.column(1)[row].as_buffer(), np.int64)
                counts = np.frombuffer(batch.column(2)[row].as_buffer(), np.int64)
                for lo in range(0, len(codes), 100_000):
                    own = codes[lo : lo + 100_000]
                    block = np.full(len(own), batch.column(0)[row].as_py(), np.int64)
                    columns = [block, np.arange(lo, lo + len(own), dtype=np.int32), own, counts[lo : lo + len(own)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "place", "pair", "n"])

    listed = blocks.where("pairs IS NOT NULL").select("block", "pairs", "pair_links")
    return listed.mapInArrow(run, "block long, place int, pair long, n long")


def ranked_pairs(pairs: DataFrame, width: int) -> DataFrame:
    """pair, count, best: links of a pair over all blocks, and whether no pair with its id of B has more.

    ``width`` is the number of ids of B, which bounds the table of highest counts that is broadcast.
    """
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("highest"))
    known = counts.withColumn("b", F.col("pair") % width).join(F.broadcast(highest), "b")
    return known.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def alignment_summary(
    documents: DataFrame,
    a: str,
    b: str,
    key: str = "doc_id",
    text: str = "text",
    batch_bytes: int = BATCH_BYTES,
    block_words: int = BLOCK_WORDS,
    kept: int = KEPT,
) -> DataFrame:
    """One row for each text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Links are the token pairs whose byte ranges end together. The count of a pair of ids is the number of
    its links in all texts; ``n_best`` are the links whose count is the highest of their id of B, and
    ``count_sum`` adds the counts of all links. ``groups_sha256`` is of ``a1,a2|b1;a3|b2,b3``.
    """
    import sentencepiece

    spark = documents.sparkSession
    key_type = documents.schema[key].dataType
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("doc_id", key_type)]
        + [T.StructField(n, T.LongType()) for n in COUNTED]
        + [T.StructField("groups_sha256", T.StringType())]
        + [T.StructField(n, T.BinaryType()) for n in LISTED]
    )
    rows = _chosen(documents, key, text)
    run = _aligner(a, b, batch_bytes, block_words, kept, schema.names, pa.schema(rows.limit(0).toArrow().schema).field(0).type)
    path = new_path(spark, "aligned-blocks")
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(schema).parquet(path)

    width = sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size()
    pairs = pair_counts(blocks)
    placed = pairs.join(ranked_pairs(pairs, width), "pair").select("block", "place", "count", "best")
    out = T.StructType([f for f in schema if f.name in ("doc_id", *COUNTED)] + [T.StructField(n, T.LongType()) for n in ("n_best", "count_sum")] + [schema["groups_sha256"]])
    texts = blocks.drop("pairs", "pair_links")
    return texts.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(_looked_up, out)


def _looked_up(rows: pa.Table, placed: pa.Table) -> pa.Table:
    """Texts of a block with the sums over their links, by pairs, words and texts."""
    at = np.argsort(placed.column("place").to_numpy())
    listed = rows.filter(pc.is_valid(rows.column("word_pairs")))
    where, sizes = (np.frombuffer(listed.column(c)[0].as_buffer(), "<u4") for c in ("word_pairs", "word_sizes"))
    sums = []
    for column in ("best", "count"):
        of_pair = placed.column(column).to_numpy().astype(np.int64)[at]
        sums.append(summed_by(of_pair[where], sizes.astype(np.int64)))
    texts = rows.filter(pc.is_valid(rows.column("words")))
    found = [[], []]
    for words in texts.column("words"):
        own = np.frombuffer(words.as_buffer(), "<u4")
        for of_word, kept in zip(sums, found):
            kept.append(int(of_word[own].sum()))
    columns = [texts.column(c) for c in ("doc_id", *COUNTED)]
    columns += [*[pa.array(f, pa.int64()) for f in found], texts.column("groups_sha256")]
    return pa.table(columns, names=["doc_id", *COUNTED, "n_best", "count_sum", "groups_sha256"])
