import random

import numpy as np
import pytest

from termgauge.llm import language

PARTS = {"en": "the and th er on ing ed ly ou".split(), "de": "der die sch ung keit lich ein zu".split(), "fr": "le é eux ai que la ç tion".split()}


def sample(lang, n, pick):
    return " ".join("".join(pick.choices(PARTS[lang], k=pick.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def known(spark):
    pick = random.Random(1)
    rows = [(sample(lang, 60, pick), lang) for lang in PARTS for _ in range(50)] + [(None, "en"), ("text", None)]
    return language.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=30)


def test_held_out_accuracy(known, docs_of):
    pick = random.Random(2)
    want = [pick.choice(list(PARTS)) for _ in range(200)]
    texts = [sample(w, pick.choice([8, 20, 200]), pick) for w in want]
    rows = language.classify(docs_of([t.upper() for t in texts]).drop("score"), known, only=["doc_id"]).collect()
    right = sum(r.lang_pred == want[r.doc_id] for r in rows)
    assert right >= 194 and all(0 <= r.score <= 1 for r in rows)


def test_undetermined_and_long(known, docs_of):
    pick = random.Random(3)
    long = sample("fr", 100_000, pick)
    texts = [None, "", " 123 !!", "\n", long, sample("en", 10, pick)]
    rows = {r.doc_id: r for r in language.classify(docs_of(texts).drop("score"), known).collect()}
    assert [rows[i].lang_pred for i in range(4)] == ["und"] * 4 and all(rows[i].rejected for i in range(4))
    assert [rows[i].score for i in range(4)] == [0.0] * 4
    assert rows[4].lang_pred == "fr" and not rows[4].rejected


def test_accepted_keeps_columns_and_rows(known, docs_of):
    pick = random.Random(4)
    text = sample("de", 30, pick)
    df = docs_of([text, text, None, "42"], [None, None, 3, 4])
    out = language.accepted(df, known)
    assert out.columns == df.columns and [(r.doc_id, r.text, r.score) for r in out.collect()] == [(None, text, "x")] * 2
    with pytest.raises(ValueError):
        language.classify(df, known)


def test_ties_and_nothing(spark, docs_of):
    same = {"a": b"xx yy zz", "b": b"xx yy zz"}
    row = language.classify(docs_of(["xx yy"]).drop("score"), same).first()
    assert (row.lang_pred, row.margin, row.rejected) == ("a", 0.0, True)
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert none == {}
    assert language.classify(docs_of(["xx"]).drop("score"), none).first().lang_pred == "und"
    assert language.classify(docs_of([]).drop("score"), same).count() == 0
    assert language.classify(docs_of(["only"]).drop("score"), {"a": b"x"}).first().score == 1.0


def test_fit_is_bounded(spark):
    rows = [("abc " * 1000, "en")] * 20 + [("def " * 1000, "de")] * 2
    got = language.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=3, text_chars=100)
    assert {k: len(v) for k, v in got.items()} == {"en": 302, "de": 201}


def test_decide():
    best, score, margin = language.decide(np.array([120, 100, 150]))
    assert best == 1 and score > 0.99 and margin == 0.2


def test_copies_do_not_displace_texts(spark):
    rows = [(f"text {chr(97 + i // 26)}{chr(97 + i % 26)}", "en") for i in range(20)]
    rows += [(f"{c} much copied", "en") for c in "abcdefgh" for _ in range(50)]
    got = language.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=28)
    assert sorted(got["en"].decode().split("\n")) == sorted({t for t, _ in rows})
