import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termgauge.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = ["", None, " \n\t", "x", "a\n\na\n a\na", "x\n \nx\n\n x\nx", "a\x1fb c\xa0d", "#*$%&|<>!", "é ü #", "\n\n", "a b c d e f g h " * 3, "one two three four five six seven eight nine"]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def random_texts(n, seed):
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        line = lambda: " ".join(pick.choices(["aa", "b#", "Ccc", "dé", "e!"], k=pick.randint(0, 9)))
        lines = [line() for _ in range(pick.randint(0, 6))]
        out.append("\n".join(lines + pick.choices(lines or [""], k=pick.randint(0, 3))))
    return out


def test_counts():
    texts = TEXTS + random_texts(300, 1) + ["long " * 50_000 + "\n" + "w" * 300_000]
    got = {row: tuple(c.values()) for row, c, _, _ in quality.measure(pa.array(texts, pa.string()))}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_viterbi_is_the_best_of_all_sequences():
    pick = np.random.default_rng(2)
    for n in range(1, 9):
        field = quality.Field(pick.normal(size=3), pick.normal(size=(2, 2)))
        x = pick.normal(size=(n, 3))
        emit = x @ field.weights

        def value(marks):
            return sum(e for e, m in zip(emit, marks) if m) + sum(field.moves[a, b] for a, b in zip(marks, marks[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(field.decode(x)) == best


def test_gradient():
    pick = np.random.default_rng(3)
    field = quality.Field(pick.normal(size=2), pick.normal(size=(2, 2)))
    x, marks = pick.normal(size=(5, 2)), np.array([0, 1, 1, 0, 1])

    def likelihood(w, m):
        own = quality.Field(w, m)
        emit = x @ own.weights
        value = lambda s: sum(e for e, k in zip(emit, s) if k) + sum(m[a, b] for a, b in zip(s, s[1:]))
        return value(marks) - np.log(sum(np.exp(value(s)) for s in itertools.product((0, 1), repeat=5)))

    by_w, by_m = quality._likelihood(field, x, marks)
    step = 1e-6
    for i in range(2):
        w = field.weights.copy()
        w[i] += step
        assert (likelihood(w, field.moves) - likelihood(field.weights, field.moves)) / step == pytest.approx(by_w[i], abs=1e-4)
    for i, j in itertools.product((0, 1), repeat=2):
        m = field.moves.copy()
        m[i, j] += step
        assert (likelihood(field.weights, m) - likelihood(field.weights, field.moves)) / step == pytest.approx(by_m[i, j], abs=1e-4)


def test_fit_and_judge(spark, docs_of):
    pick = random.Random(4)
    words = [f"word{i}" for i in range(900)]
    good = ["\n".join(" ".join(pick.sample(words, 12)) for _ in range(4)) for _ in range(60)]
    bad = ["\n".join(" ".join(w + "###" for w in pick.sample(words, 12)) for _ in range(4)) for _ in range(60)]
    known = good[:40] + bad[:40] + [None, "x", "y"]
    labels = [(i, int(i < 40)) for i in range(80)] + [(80, 1), (81, None), (None, 1), (5, 1), (999, 0)]
    field = quality.fit_field(docs_of(known), spark.createDataFrame(labels, "doc_id long, quality int"))
    mixed = "\n".join(good[50].split("\n") + bad[50].split("\n")[:1])
    texts = good[40:] + bad[40:] + [mixed, None, "", "too few words", "a b c d e f g h " * 30]
    out = {r.doc_id: r for r in quality.judge(docs_of(texts), field).collect()}
    assert [out[i].kept for i in range(40)] == [True] * 20 + [False] * 20
    assert out[40].kept and 0.5 < out[40].content_share < 1
    assert [(out[i].base_failed, out[i].kept) for i in range(41, 45)] == [(True, False)] * 4


def test_without_labels_and_rows(spark, docs_of):
    field = quality.fit_field(docs_of(["x"]), spark.createDataFrame([], "doc_id long, quality int"))
    text = " ".join(f"w{i}" for i in range(30))
    out = quality.judge(docs_of([text, text], [None, None]), field)
    assert [(r.doc_id, r.kept) for r in out.collect()] == [(None, True)] * 2
    assert quality.judge(docs_of([]), field).count() == 0
    assert out.where(F.col("base_failed")).count() == 0
