"""Token counts of whole texts, encoded in batches of even size.

Texts are encoded inside Arrow functions that return lengths only: no id leaves a task. A long text
is cut at safe boundaries, places that no token of the tokenizer can span, so that the counts of its
pieces add up to the count of the whole. By the same rule words have counts of their own, and a word that a
process has met before is not encoded again. What is left of all texts of a part of a batch is grouped
into calls of about the same number of bytes, which bounds what the library holds at a time.

A boundary is safe in these cases, which are read from the tokenizer's own file:

- a byte-level BPE with the usual pattern and no normaliser: white space after another character
  starts a new word, and words are encoded by themselves;
- a BPE whose pattern keeps words only and drops white space, behind normalisers that work within a
  word (composition, small letters, white space made one blank);
- a sentencepiece model none of whose pieces holds a blank after another character: at a single blank,
  which the second piece leaves out where the model puts one before every text.

No added token may hold white space, swallow it beside itself or demand whole words. With any other
tokenizer texts stay whole, and so does a text without such a place.

Defined results: a NULL or empty text has 0 bytes and 0 tokens; repeated rows and repeated or NULL
keys are counted like any other row; an empty table gives no rows; texts of any length are counted to
their end; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE_CHARS = 1 << 16  # a longer text is cut at the first safe boundary after so many characters
CALL_BYTES = 1 << 18  # of text for a call of the library
SLICE_BYTES = 1 << 21  # of text made Python strings at a time
KEPT = 400_000  # words whose counts a process keeps

BLANK_BEFORE_WORD = re.compile(r"(?<=\S)[ \n]")
WORD_BLANK, ODD_BLANK = re.compile(r" (?=\S)"), re.compile(r" (?:\s|$)")
SINGLE_BLANK, NOT_SINGLE = re.compile(r"(?<=[^ ]) (?=[^ ])"), re.compile(r"^ |  | $")
SINGLE_BLANK_ASCII, ANY = re.compile(r"(?<=[!-~]) (?=[!-~])"), re.compile("")
#: Characters that normalisers of the kinds K and C change.
CHANGED = "ﬁ½´é"

_opened: dict[str, Counter] = {}


class Counter:
    """Counts the tokens of texts by the library that a tokenizer file is for.

    Words between blanks that are safe boundaries have counts of their own. Those met before are
    looked up, at most ``KEPT`` of them; the library is asked for the others, in calls of even size.
    """

    #: Pattern of the safe boundaries for pieces, or None; whether a piece leaves out the blank before it.
    boundary: re.Pattern | None = None
    dropped = False
    #: Pattern of the safe blanks between words, and of a text in which some blank is not one.
    blank, odd = WORD_BLANK, ODD_BLANK

    def __init__(self):
        self.kept: dict[str, int] = {}

    def lengths(self, texts: list[str]) -> list[int]:
        raise NotImplementedError

    def pieces(self, text: str, size: int = PIECE_CHARS) -> list[str]:
        """The text cut at safe boundaries, each piece of at least ``size`` characters but for the last."""
        if len(text) <= size or self.boundary is None:
            return [text]
        found, start = [], 0
        while len(text) - start > size and (cut := self.boundary.search(text, start + size)):
            found.append(text[start : cut.start()])
            start = cut.end() if self.dropped else cut.start()
        return [*found, text[start:]]

    def words(self, piece: str) -> list[str]:
        """The parts between safe blanks."""
        if self.boundary is None:
            return [piece]
        return self.blank.split(piece) if self.odd.search(piece) else piece.split(" ")

    def encoded(self, texts: list[str], call: int) -> list[int]:
        """Lengths from the library, in calls of about ``call`` bytes."""
        weight = np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in texts])
        return [n for lo, hi in even_calls(weight, call) for n in self.lengths(texts[lo:hi])]

    def counts(self, texts: list[str], size: int = PIECE_CHARS, call: int = CALL_BYTES) -> np.ndarray:
        """The number of tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        if self.boundary is None:
            total[:] = self.encoded(texts, call)
            return total
        cut = [self.pieces(text, size) for text in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in cut])
        words = [self.words(piece) for own in cut for piece in own]
        np.add.at(total, owner, self.encoded([w[0] for w in words], call))
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        new = list({w for own in words for w in set(own[1:]).difference(kept)})
        kept.update(zip(new, self.encoded(new if self.dropped else [" " + w for w in new], call)))
        np.add.at(total, owner, [sum(map(kept.__getitem__, own[1:])) for own in words])
        return total


def even_calls(weight: np.ndarray, call: int) -> list[tuple[int, int]]:
    """Ranges of pieces for the running sum ``weight`` of their bytes, each of about ``call`` bytes."""
    if not len(weight):
        return []
    n = max(1, -(-int(weight[-1]) // call))
    cuts = np.searchsorted(weight, np.arange(1, n) * (weight[-1] / n)) + 1
    bounds = np.unique([0, *cuts.tolist(), len(weight)])
    return list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))


class JsonCounter(Counter):
    """A tokenizer of the library ``tokenizers``."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            if splits_at_blanks(json.load(file)):
                self.boundary = BLANK_BEFORE_WORD

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(found) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def splits_at_blanks(told: dict) -> bool:
    """Whether no token of a tokenizer file spans the place between a word and white space after it."""
    for token in told.get("added_tokens") or []:
        if token.get("lstrip") or token.get("rstrip") or token.get("single_word") or re.search(r"\s", token["content"]):
            return False
    before, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    if model.get("type") != "BPE":
        return False
    if before.get("type") == "ByteLevel":
        return bool(before.get("use_regex", True)) and not before.get("add_prefix_space") and told.get("normalizer") is None
    normalizer = told.get("normalizer") or {"type": "Sequence", "normalizers": []}
    parts = normalizer.get("normalizers", [normalizer])
    within = all(p["type"] in ("NFC", "Lowercase") or p == WHITE_SPACE_TO_BLANK for p in parts)
    first, *rest = before.get("pretokenizers", [before])
    words = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    words = words and not re.search(r"\\s(?!\\)|\\S| ", first["pattern"].get("Regex", " "))
    plain = all(p.get("type") == "ByteLevel" and not p.get("use_regex") and not p.get("add_prefix_space") for p in rest)
    return bool(within and words and plain)


WHITE_SPACE_TO_BLANK = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}


class PieceCounter(Counter):
    """A model of the library ``sentencepiece``."""

    dropped = True

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        prefixed = (self.model.encode("a", out_type=str) or [""])[0].startswith("▁")
        if prefixed and not any(re.search("[^▁]▁", p) for p in pieces):
            unchanged = self.model.normalize(CHANGED).lstrip("▁") == CHANGED
            self.boundary = self.blank = SINGLE_BLANK if unchanged else SINGLE_BLANK_ASCII
            self.odd = NOT_SINGLE if unchanged else ANY

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(found) for found in self.model.encode(texts, num_threads=1)]


def counter(path: str) -> Counter:
    """The counter of a tokenizer file, opened once in a process."""
    if path not in _opened:
        kinds = {".json": JsonCounter, ".model": PieceCounter}
        ending = os.path.splitext(path)[1]
        if ending not in kinds:
            raise ValueError(f"not a tokenizer file: {path}")
        _opened[path] = kinds[ending](path)
    return _opened[path]


def byte_slices(batch: pa.RecordBatch, sizes: np.ndarray, most: int = SLICE_BYTES):
    """Parts of a batch, each of about ``most`` bytes of text or one row."""
    for lo, hi in even_calls(np.cumsum(sizes), most):
        yield batch.slice(lo, hi - lo), sizes[lo:hi]


def text_sizes(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for NULL."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def count_tokens(
    documents: DataFrame,
    tokenizer: str,
    limit: int = 512,
    key: str = "doc_id",
    text: str = "text",
    piece_chars: int = PIECE_CHARS,
    call_bytes: int = CALL_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of each row.

    ``tokenizer`` is a file that every executor has at the same path. Counts are those of the library
    at its defaults, without begin, end or added special tokens, truncation or padding.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema[key].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def run(batches):
        own = counter(tokenizer)
        for batch in batches:
            for part, sizes in byte_slices(batch, text_sizes(batch.column(1))):
                tokens = own.counts([t or "" for t in part.column(1).to_pylist()], piece_chars, call_bytes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(tokens)], names=schema.names)

    rows = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
