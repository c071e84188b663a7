import re
import hashlib

import pytest

from termgauge.llm import warc
from termgauge.session import new_path


@pytest.fixture
def archive(spark):
    def run(rows, **options):
        df = spark.createDataFrame(rows, "page_id long, url string, html string, body int, refers_to string")
        path = new_path(spark, "warc-test")
        warc.write_archives(df, path, **options)
        return sorted((tuple(r) for r in warc.read_archives(spark, path).drop("url").collect()), key=str)

    return run


def want(rows, least=1000):
    large = {}
    for key, _, html, *_ in rows:
        body = (html or "").encode()
        if len(body) >= least:
            large[body] = max(large.get(body, -1), -1 if key is None else key)
    out = []
    for key, _, html, *_ in rows:
        body = (html or "").encode()
        first = large.get(body)
        again = first is not None and first >= 0 and key != first
        digest = hashlib.sha1(body).hexdigest()
        out.append((key, len(body), digest, "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_revisits(archive):
    big, bytes_999, bytes_1000 = "ü" * 700, "a" * 999, "é" * 500
    rows = [(1, "u", big, 1, "x"), (9, "v", big, 1, "x"), (5, None, big, 1, "x"), (2, "u", bytes_999, 1, "x"), (3, "u", bytes_999, 1, "x")]
    rows += [(4, "u", bytes_1000, 1, "x"), (6, "u", bytes_1000, 1, "x"), (7, "u", None, 1, "x"), (8, "u", "", 1, "x")]
    assert archive(rows) == want(rows)


def test_payloads_that_look_like_records(archive):
    head = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 50
    rows = [(1, "a\r\nContent-Length: 0", head, 1, "x"), (2, "b", "\r\n\r\n", 1, "x"), (3, "c", head, 1, "x"), (4, "d", "é" * 200_000, 1, "x")]
    assert archive(rows) == want(rows)


def test_repeated_rows_and_null_keys(archive):
    big = "z" * 1500
    rows = [(3, "u", big, 1, "x"), (3, "u", big, 1, "x"), (1, "u", big, 1, "x"), (1, "u", big, 1, "x"), (None, "u", big, 1, "x")]
    got = archive(rows)
    assert [r[3] for r in got if r[0] == 3] == ["response"] * 2
    assert [r[4] for r in got if r[0] != 3] == [3] * 3
    assert archive([(None, None, big, 1, "x"), (None, None, big, 1, "x")]) == [(None, 1500, hashlib.sha1(big.encode()).hexdigest(), "response", None)] * 2


def test_many_files_and_none(archive):
    rows = [(i, "u", f"{i % 7}" * 1200, 1, "x") for i in range(100)]
    assert archive(rows, records_per_file=9) == want(rows)
    assert archive([]) == []


def test_a_damaged_archive_is_not_read():
    import gzip

    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\n")))


def test_required_fields_of_every_record(spark, tmp_path):
    import glob
    import gzip

    rows = [(1, "u", "a" * 1200, 1, "x"), (2, "u", "a" * 1200, 1, "x"), (3, None, None, 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n int, other string")
    warc.write_archives(pages, f"{tmp_path}/out")
    heads = [f for path in glob.glob(f"{tmp_path}/out/*.gz") for f, _ in warc.parse(open(path, "rb").read())]
    assert len(heads) == 3 and len({f["WARC-Date"] for f in heads}) == 1
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", f["WARC-Date"]) for f in heads)
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\n{}Content-Length: 3\r\n\r\nab{}\r\n\r\n"
    dated = "WARC-Date: 2020-01-01T00:00:00Z\r\n"
    assert len(list(warc.parse(gzip.compress(head.format(dated, "c").encode())))) == 1
    with pytest.raises(ValueError, match="without its end"):
        list(warc.parse(gzip.compress(head.format(dated, "cd").encode())))
    with pytest.raises(ValueError, match="lacks a field"):
        list(warc.parse(gzip.compress(head.format("", "c").encode())))
