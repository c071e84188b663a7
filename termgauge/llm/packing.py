"""Documents concatenated in stored order and cut into sequences of a fixed number of tokens.

Pass one tokenises every text once and writes the ids with the running total of their block (the
rows of one task). The totals of the blocks, one row for each, are summed to global offsets. Pass
two cuts each document at the multiples of the sequence length: a piece for each sequence that it
touches, with boundary records (sequence, offset). Only the last sequence can be short, so the
padding is less than one sequence for the whole table.

Defined results: a NULL or empty text has the end id alone; repeated rows and repeated or NULL
document ids are packed like any other row; an empty table gives no pieces; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgauge.session import new_path

LENGTH = 1024
END_ID = 0
CACHED = 600_000

_encoders: dict[tuple[str, bool], Encoder] = {}


# The byte-level pre-tokeniser's pattern, and the letters that it writes for bytes (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, int]:
    """Printing bytes stand for themselves; the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class Encoder:
    """Ids of texts as little-endian 16-bit or 32-bit bytes.

    A byte-level pre-tokeniser never joins what stands before a blank that a printing character
    follows with what stands after it, so the parts between such blanks have ids of their own, and
    so have the words that the pattern finds in a part. Parts and words that were met before are
    looked up, at most ``CACHED`` of either; the model of the tokenizer is asked for the others.
    Any other tokenizer encodes whole texts, and so does this one where a text holds an added token
    (unless ``plain``: then their strings are ordinary text).
    """

    def __init__(self, path: str, plain: bool = False):
        import json
        import re

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain and t.special)]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else None
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        before = told.get("pre_tokenizer") or {}
        self.by_parts = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and told.get("normalizer") is None
            and told["model"].get("type") == "BPE"
        )
        self.split = re.compile(r" (?=\S)").split
        self.odd = re.compile(r" (?:\s|$)").search
        self.find = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        written = word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.tokenizer.model.tokenize(written)], self.kind).tobytes()
        if len(self.words) >= CACHED:
            self.words.clear()
        self.words[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        words = self.words
        return b"".join([words.get(w) or self._word(w) for w in self.find(part)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without an end id."""
        if not self.by_parts:
            rows = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [np.array(row.ids, self.kind).tobytes() for row in rows]
        out = []
        for text in texts:
            if self.added and self.added(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, self.kind).tobytes())
                continue
            found = self.split(text) if self.odd(text) else text.split(" ")
            kept = self.kept
            for part in set(found[1:]).difference(kept):
                if len(kept) >= CACHED:
                    kept.clear()
                    kept.update((p, self._part(" " + p)) for p in set(found[1:]))
                    break
                kept[part] = self._part(" " + part)
            out.append(self._part(found[0]) + b"".join(map(kept.__getitem__, found[1:])))
        return out


def encoder(path: str, plain: bool = False) -> Encoder:
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]


def tokenised(documents: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID):
    """doc_id, ids (packed bytes), doc_tokens, block, before: tokens of the block before the row.

    ``tokenizer`` is a file that every executor has at the same path.
    """
    id_type = documents.schema[key].dataType

    def encode(batches):
        from pyspark import TaskContext

        block, before, own = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.array([end_id], own.kind).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [x + end for x in own.encode(texts)]
                counts = np.array([len(x) for x in ids], np.int64) // np.dtype(own.kind).itemsize
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                columns = [part.column(0), pa.array(ids, pa.binary()), pa.array(counts)]
                columns += [pa.array(np.full(len(ids), block)), pa.array(starts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "doc_tokens", "block", "before"])

    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("ids", T.BinaryType()),
            T.StructField("doc_tokens", T.LongType()),
            T.StructField("block", T.LongType()),
            T.StructField("before", T.LongType()),
        ]
    )
    rows = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(encode, schema)


def pack(
    documents: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    width: int = 2,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's ids as unsigned little-endian 32-bit numbers. ``width`` is the
    number of bytes that ``tokenised`` uses for an id: 2 for a vocabulary of up to 65,536.
    """
    spark = documents.sparkSession
    path = new_path(spark, "packing-ids")
    rows = tokenised(documents, tokenizer, key, text, end_id)
    rows.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)

    totals = written.groupBy("block").agg(F.sum("doc_tokens").alias("tokens"))
    before_all = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("block", F.coalesce(F.sum("tokens").over(before_all), F.lit(0)).alias("base"))
    # One row for each block that pass one wrote, never for each document.
    placed = written.join(F.broadcast(offsets), "block")
    placed = placed.select("doc_id", "ids", "doc_tokens", (F.col("base") + F.col("before")).alias("at"))
    id_type = documents.schema[key].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type)]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in NUMBERS]
    )
    return placed.mapInArrow(_cutter(length, width), schema)


NUMBERS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _cutter(length: int, width: int):
    def cut(batches):
        for batch in batches:
            ids, counts = batch.column(1), batch.column(2).to_pylist()
            rows, kept, numbers = [], [], []
            size = 0
            for row, (n, at) in enumerate(zip(counts, batch.column(3).to_pylist())):
                own = np.frombuffer(ids[row].as_buffer(), f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    stop = min(n, start + length - offset)
                    piece = own[start:stop].tobytes()
                    rows.append(row)
                    kept.append(piece)
                    numbers.append((start, stop - start, zlib.crc32(piece), n, sequence, offset))
                    size += len(piece)
                    start = stop
                    if size >= 1 << 23:
                        yield _pieces(batch, rows, kept, numbers)
                        rows, kept, numbers, size = [], [], [], 0
            if rows:
                yield _pieces(batch, rows, kept, numbers)

    return cut


def _pieces(batch, rows, kept, numbers):
    columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(kept, pa.binary())]
    columns += [pa.array(c, pa.int64()) for c in zip(*numbers)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", *NUMBERS])


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (32-bit bytes), n_tokens: pieces of a sequence put together, at most its length."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    hexed = F.array_join(F.transform(ordered, lambda p: F.hex(p["ids"])), "")
    return pieces.groupBy("sequence_id").agg(F.unhex(hexed).alias("ids"), F.sum("length").alias("n_tokens"))
