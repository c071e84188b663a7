"""Language by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content zstandard dictionary, put together from a bounded number of its
labelled texts. A whole text is compressed once with every dictionary. The score is the share of
the best language under a soft minimum of the bytes for each byte of text that was compared;
a text is rejected when the best and the second size differ by less than ``margin`` of the best.

Letters are lower-cased and everything else is a blank, in the dictionaries as in the texts. A text
is compressed in blocks of ``BLOCK`` bytes, so memory stays bounded for texts of any length, and a
repeated passage cannot hide behind itself. If two languages tie, the blocks are compressed again
in parts of ``FINE`` bytes and the sizes added. A text without any letter is ``und`` and rejected,
as is a NULL or empty one.

Fitting takes at most ``per_language`` labelled texts of each language, those with the smallest
hash, and at most ``text_chars`` of each; both are parameters. Copies of a text come after all other texts. All texts are classified.

Defined results: equal texts have equal results; of equal sizes the first language by name wins,
with a margin of 0; repeated rows stay; an empty table gives no rows; without labelled texts every
text is ``und``; the input's columns are kept and may not be named like the result's, except in
``classify(..., only=[...])``, which keeps those named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termgauge.llm.memory import freed

PER_LANGUAGE = 400
TEXT_CHARS = 512
LANGUAGES = 256
MARGIN = 0.002
BLOCK, FINE = 512, 64
LEVEL = 3
UNKNOWN = "und"


def letters(text: Column) -> Column:
    """Lower case, with a blank for every run of other characters than letters."""
    return F.regexp_replace(F.lower(text), r"\P{L}+", " ")


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
    text_chars: int = TEXT_CHARS,
) -> dict[str, bytes]:
    """A dictionary for each language: a bounded number of bytes of a bounded number of texts."""
    rows = labelled.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.col(f"`{lang}`").alias("lang"), F.left(letters(F.col(f"`{text}`")), F.lit(text_chars)).alias("text"))
    rows = rows.groupBy("lang", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("rank", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("rank", "text")
    chosen = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)
    names = [r.lang for r in rows.groupBy("lang").agg(F.sum("copies").alias("count")).orderBy(F.desc("count"), "lang").limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found: dict[str, list[bytes]] = {name: [] for name in sorted(names)}
    again: dict[str, list[bytes]] = {name: [] for name in found}
    for r in chosen.orderBy("lang", "n").select("lang", "text", "copies").collect():
        found[r.lang].append(r.text.encode())
        again[r.lang] += [r.text.encode()] * (min(r.copies, per_language) - 1)
    for name, texts in found.items():  # copies only where there are too few texts
        texts += again[name][: per_language - len(texts)]
    return {name: b"\n".join(texts) for name, texts in found.items()}


class Compressors:
    """A compressor for each language."""

    def __init__(self, contents: dict[str, bytes], level: int = LEVEL):
        self.names = sorted(contents)
        self.own = []
        for name in self.names:
            known = zstandard.ZstdCompressionDict(contents[name] or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.own.append(
                zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False)
            )

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed bytes of the whole text under each dictionary."""
        total = self._sizes(text, BLOCK)
        if len(total) > 1 and np.ptp(np.partition(total, 1)[:2]) == 0:
            total += self._sizes(text, FINE)
        return total

    def _sizes(self, text: bytes, block: int) -> np.ndarray:
        view = memoryview(text)
        parts = [view[lo : lo + block] for lo in range(0, len(text), block)]
        return np.array([sum(len(c.compress(part)) for part in parts) for c in self.own], np.int64)


def decide(sizes: np.ndarray) -> tuple[int, float, float]:
    """Position of the smallest size, score in 0 to 1, margin to the second as a share."""
    best = int(np.argmin(sizes))
    if len(sizes) == 1:
        return best, 1.0, 1.0
    second = int(np.partition(sizes, 1)[1])
    weights = np.exp(-(sizes - sizes[best]) * (40.0 / max(float(sizes[best]), 1.0)))
    return best, float(1.0 / weights.sum()), (second - int(sizes[best])) / max(int(sizes[best]), 1)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def classify(
    documents: DataFrame,
    dictionaries: dict[str, bytes],
    text: str = "text",
    margin: float = MARGIN,
    only: list[str] | None = None,
) -> DataFrame:
    """The rows with lang_pred, score, margin, rejected."""
    kept = documents.columns if only is None else only
    if clash := {"lang_pred", "score", "margin", "rejected"} & set(kept):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)
    rows = documents.select(
        letters(F.col(f"`{text}`")).alias("_text"), has_letter(F.col(f"`{text}`")).alias("_letter"), *[F.col(f"`{c}`") for c in kept]
    )
    fields = [documents.schema[c] for c in kept] + [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]):
        own = Compressors(shared.value)
        for batch in batches:
            names, scores, margins = [], [], []
            texts = pc.cast(batch.column(0), pa.binary())
            for value, letter in zip(texts, batch.column(1)):
                if not (letter.as_py() and own.names):
                    names.append(UNKNOWN), scores.append(0.0), margins.append(0.0)
                    continue
                best, score, gap = decide(own.sizes(value.as_py()))
                names.append(own.names[best]), scores.append(score), margins.append(gap)
            gone = [n == UNKNOWN or m < margin for n, m in zip(names, margins)]
            result = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], *result, pa.array(gone, pa.bool_())], names=[f.name for f in fields]
            )

    return rows.mapInArrow(freed(run), T.StructType(fields))


def accepted(documents: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``documents`` that are not rejected, with their own columns."""
    names = documents.columns
    inner = documents.select(*[F.col(f"`{c}`").alias(f"given_{c}") for c in names])
    found = classify(inner, dictionaries, f"given_{text}", margin).where(~F.col("rejected"))
    return found.select(*[F.col(f"`given_{c}`").alias(c) for c in names])
