"""Texts as zstandard bytes, for shuffles that only carry them."""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from termgauge.llm.memory import freed


def _with(documents: DataFrame, text: str, kind: T.DataType, change, to: pa.DataType) -> DataFrame:
    at = documents.columns.index(text)
    schema = T.StructType([T.StructField(f.name, kind if i == at else f.dataType) for i, f in enumerate(documents.schema)])

    def run(batches):
        own = change()
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                columns = list(batch.columns)
                columns[at] = pa.array([None if x is None else own(x) for x in columns[at].to_pylist()], to)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return documents.mapInArrow(freed(run), schema)


def squeezed(documents: DataFrame, text: str = "text", level: int = 3) -> DataFrame:
    """The same rows with the column ``text`` as compressed bytes; NULL stays NULL."""

    def change():
        own = zstandard.ZstdCompressor(level=level).compress
        return lambda x: own(x.encode())

    return _with(documents, text, T.BinaryType(), change, pa.binary())


def expanded(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``squeezed`` as they were."""

    def change():
        own = zstandard.ZstdDecompressor().decompress
        return lambda x: own(x).decode()

    return _with(documents, text, T.StringType(), change, pa.string())
