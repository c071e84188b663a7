"""The registered queries over the smallest tables, against SQL or a brute-force version."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_alignment import brute as alignment_brute
from test_jaccard import brute as jaccard_brute
from test_quality import brute as quality_brute
from test_suffix import brute as suffix_brute
from test_whitening import compare as whitening_compare
from tokenizers import Tokenizer

from termgauge.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF_DIR)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_op6(spark, docs):
    rows = sorted((tuple(r) for r in queries.op6_jaccard(spark, SF_DIR).collect()), key=str)
    assert rows == jaccard_brute(docs)


def test_op10(spark, docs):
    rows = sorted((tuple(r) for r in queries.op10_suffix_dedup(spark, SF_DIR).collect()), key=str)
    assert rows == suffix_brute(docs)


def test_op5(spark, docs):
    got = {r.doc_id: r for r in queries.op5_quality(spark, SF_DIR).collect()}
    for i, text in docs:
        r, want = got[i], quality_brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.base_failed and r.kept)


def test_op4(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in docs}
    rows = queries.op4_pack(spark, SF_DIR).collect()
    at, held = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(own) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        at[r.doc_id] = r.start + r.length
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(own) for i, own in ids.items()} and sorted(held) == list(range(len(held)))
    for number, pieces in held.items():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and (ends[-1] == 1024 or number == len(held) - 1)


def test_op11(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_DIR}/embeddings.parquet'").fetchall()
    whitening_compare(rows, queries.op11_whitening(spark, SF_DIR).collect(), 16)


def test_op12(spark, docs):
    rows = sorted((tuple(r) for r in queries.op12_alignment(spark, SF_DIR).collect()), key=str)
    assert rows == alignment_brute(docs)


def test_op13(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted(tuple(r) for r in queries.op13_token_counts(spark, SF_DIR).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    counted = [(i, t or "", len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in docs]
    assert rows == sorted((i, len(t.encode()), n, n > 512) for i, t, n in counted)


@pytest.mark.parametrize("name, columns", [("op7_toxicity", {"doc_id", "held_out", "score", "predicted"}), ("op8_language", {"doc_id", "held_out", "lang_pred", "score"})])
def test_models(spark, docs, name, columns):
    out = queries.QUERIES[name](spark, SF_DIR)
    rows = out.collect()
    assert columns <= set(out.columns) and sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    assert all(0 <= r.score <= 1 for r in rows)


def test_accuracy(spark, duck):
    rows = [(r.doc_id, r.held_out, r.lang_pred) for r in queries.op8_language(spark, "/root/testdata/sf0.01").collect()]
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [lang[i] == p for i, h, p in rows if h]
    assert sum(held) / len(held) > 0.95


def test_matches(spark, docs):
    assert {r.doc_id for r in queries.op9_decontaminate(spark, SF_DIR).collect()} <= {i for i, _ in docs}
    found = {r.doc_id for r in queries.op2_license_scan(spark, SF_DIR).collect()}
    assert {i for i, t in docs if "Released under the MIT License." in t} <= found
