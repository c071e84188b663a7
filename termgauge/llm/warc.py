"""WARC archives whose repeated payloads are revisit records of one response.

The headers (key, payload length, payload digest) are aggregated by digest with partial sums, so
a payload that a third of all rows share costs one row per task. Revisit headers are joined to
the pages by key, which is nearly unique, and the archives are written by Spark's own writer, each
record ended by the two line ends that the format asks for. They are read back file by file with
a parser that follows ``Content-Length``, so a payload may contain anything, record heads included.

Defined results: a NULL payload is empty; a NULL key counts below every other key and is kept;
repeated rows with the same key and payload are all responses if the key is the largest of its
payload, and all revisits otherwise; other columns of the input are ignored, whatever their names.
An empty table gives no archives and no rows. Every record is dated by the time at which the query that
writes the archives started, in UTC.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termgauge.session import materialise

MIN_REVISIT = 1000
END = "\r\n\r\n"
REQUIRED = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"}  # of every record, by the format
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def headers(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest of every row."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    return pages.select(
        F.col(f"`{key}`").alias("page_id"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.sha1(body.cast("binary")).alias("payload_digest"),
    )


def revisits(heads: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, payload_digest, refers_to: headers whose payload belongs to a larger key."""
    large = heads.where(F.col("payload_bytes") >= min_bytes)
    firsts = large.groupBy("payload_digest").agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")
    )
    repeated = firsts.where("copies > 1").drop("copies")
    # One row for each digest meets many headers: a plain equi-join, of which Spark splits hot partitions.
    return (
        large.join(repeated, "payload_digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "payload_digest", "refers_to")
        .distinct()
    )


def _record(body: Column) -> Column:
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    revisit = F.col("refers_to").isNotNull()
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    lines = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), number("page_id"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.col("url"), "[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), number("refers_to"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("payload_bytes")).cast("string")),
    )
    return F.concat(lines, F.lit(END), F.when(revisit, "").otherwise(body))


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    payload: str = "html",
    url: str = "url",
    min_bytes: int = MIN_REVISIT,
    records_per_file: int = 5000,
) -> None:
    """Write one record for each row to gzip archives under ``path``."""
    heads = materialise(headers(pages, key, payload), "warc-headers")
    again = materialise(revisits(heads, min_bytes), "warc-revisits")
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").alias("page_id"),
        F.col(f"`{url}`").alias("url") if url in pages.columns else F.lit(None).cast("string").alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("bigint").alias("payload_bytes"),
        F.sha1(body.cast("binary")).alias("payload_digest"),
    )
    again = again.withColumnsRenamed({"page_id": "_page", "payload_digest": "_digest"})
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    joined = rows.join(again, same, "left")
    records = joined.select(_record(F.col("body")).alias("value"))
    writer = records.write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def _number(value: str) -> int | None:
    value = value.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def parse(content: bytes):
    """(header fields, payload) of every record of one gzip archive."""
    data, at = zlib.decompress(content, 31), 0
    while at < len(data):
        stop = data.index(END.encode(), at)
        first, *lines = data[at:stop].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not the head of a record")
        fields = dict(line.split(": ", 1) for line in lines)
        if not REQUIRED <= fields.keys():
            raise ValueError("the head of a record lacks a field")
        begin = stop + len(END)
        at = begin + int(fields["Content-Length"])
        yield fields, data[begin:at]
        if data[at : at + len(END)] != END.encode():
            raise ValueError("a record without its end")
        at += len(END)


def _read(batches):
    schema = pa.schema(
        [(n, pa.int64() if k == "bigint" else pa.string()) for n, k in (x.split() for x in RECORD.split(", "))]
    )
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, payload in parse(content.as_py()):
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = fields["WARC-Type"]
                if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError("payload and digest differ")
                refers = fields.get("WARC-Refers-To")
                rows.append(
                    (
                        _number(fields["WARC-Record-ID"]),
                        fields.get("WARC-Target-URI"),
                        int(fields["X-Payload-Length"]),
                        digest,
                        kind,
                        _number(refers) if refers else None,
                    )
                )
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read, RECORD)
