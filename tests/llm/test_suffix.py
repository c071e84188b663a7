import hashlib
import random

import numpy as np
import pytest

from termgauge.llm import suffix


def brute(rows):
    """The rule, string by string: an occurrence is earlier if its (key, start) is smaller."""
    order = lambda i: (i is not None, i or 0)
    least, out = {}, []
    for i, t in rows:
        data = (t or "").encode()
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            least[w] = min(least.get(w, (order(i), s)), (order(i), s))
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, np.int64)
        for s in range(len(data) - 99):
            if least[data[s : s + 100]] < (order(i), s):
                gone[s] += 1
                gone[s + 100] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in suffix.remove_repeated(df).drop("kept").collect()), key=str)


def texts_of(pick, n):
    words = [f"{pick.choice('abcdefgh')}{pick.choice('xyz')}{i % 37}" for i in range(400)]
    passages = [" ".join(pick.choices(words, k=pick.randint(15, 60))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = [" ".join(pick.choices(words, k=pick.randint(0, 80)))]
        for _ in range(pick.choice([0, 0, 1, 2, 3])):
            p = pick.choice(passages)
            a = pick.randrange(len(p) // 2)
            parts += [p[a : a + pick.randint(80, 300)], " ".join(pick.choices(words, k=pick.randint(0, 20)))]
        out.append("".join(parts))
    return out


def test_all_strings(docs_of):
    pick = random.Random(1)
    texts = texts_of(pick, 60)
    texts += texts[:6] + ["é" * 150, "é" * 149 + "a", "a" * 100, "a" * 99, "a" * 350, "ab" * 120, "", None, "\0" * 130, "x" + "\0" * 130]
    rows = list(enumerate(texts))
    pick.shuffle(rows)
    df = docs_of([t for _, t in rows], [i for i, _ in rows]).repartition(5)
    assert run(df) == brute(rows)


@pytest.mark.parametrize("name, value", [("ROWS", 50), ("KINDS", 3), ("SAMPLE", 10_000)])
def test_many_kinds_of_one_passage(docs_of, monkeypatch, name, value):
    monkeypatch.setattr(suffix, name, value)
    pick = random.Random(2)
    base = " ".join(f"w{i}" for i in range(90))
    texts = []
    for _ in range(40):
        words = base.split(" ")
        words[pick.randrange(90)] = f"e{pick.randrange(99)}"
        texts.append(" ".join(words))
    assert run(docs_of(texts).repartition(6)) == brute(list(enumerate(texts)))


def test_leading_bytes_over_several_buckets(spark, docs_of, monkeypatch):
    """One passage fills many buckets; its strings are compared across them."""
    cuts = []
    plain = suffix.splitters
    monkeypatch.setattr(suffix, "splitters", lambda *a: cuts.append(plain(*a)) or cuts[-1])
    texts = [f"{'q' * (i % 3)}{i:02d}" + "z" * 120 + f"{i % 5}" + "y" * 150 for i in range(60)]
    assert run(docs_of(texts).repartition(4)) == brute(list(enumerate(texts)))
    assert len(set(cuts[0].tolist())) < len(cuts[0]) - 1


def test_nulls_ties_and_nothing(docs_of):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (3, text), (None, text), (9, text), (9, None), (4, "x" + text), (4, text), (3, "")]
    got = run(docs_of([t for _, t in rows], [i for i, _ in rows]))
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] is None] == [0]
    assert run(docs_of([text, text], [3, 3])) == brute([(3, text)] * 2)
    assert suffix.remove_repeated(docs_of([])).count() == 0


def test_texts_with_other_columns(docs_of):
    text = " ".join(f"é{i}" for i in range(60))
    kept = suffix.without_repeated(docs_of([text, "ü" + text, text, None, "z"]), chars="n")
    assert kept.columns == ["doc_id", "text", "lang", "n", "score"]
    rows = {r.doc_id: (r.text, r.n, r.score) for r in kept.collect()}
    assert rows == {0: (text, 7, "x"), 1: ("ü", 1, "x"), 3: (None, 7, "x"), 4: ("z", 7, "x")}


def test_long_text(docs_of):
    pick = random.Random(3)
    long = " ".join(f"{pick.randrange(10**9)}" for _ in range(40_000))
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.remove_repeated(docs_of([long, long[1000:300_000], "q" + long])).collect()}
    assert got == {0: (0, 0), 1: (299_000, 1), 2: (len(long), 1)}


def test_multikey_quicksort_and_common_prefixes():
    pick = np.random.default_rng(4)
    words = pick.integers(0, 3, (3000, 5)).astype(np.uint64) << np.uint64(56)
    words[:, 1:] |= pick.integers(0, 2, (3000, 4)).astype(np.uint64)
    order = suffix.multikey_quicksort(words)
    assert [tuple(x) for x in words[order]] == sorted(tuple(x) for x in words)
    common = suffix._common(words, order)
    flat = [w.astype(">u8").tobytes() for w in words[order]]
    for i in range(1, 400):
        a, b = flat[i - 1], flat[i]
        same = next((k for k in range(40) if a[k] != b[k]), 40)
        assert common[i] == (same - 8 if same >= 8 else -1)


def test_anchors_depend_on_the_string_alone():
    pick = random.Random(6)
    text = bytes(pick.choices(b"abc", k=9000))
    data = np.frombuffer(text, np.uint8)
    row, at, first, last, _, _ = suffix.anchors(data, np.array([0, 4000, 9000]))
    place = {}
    for r, a, s, e in zip(row, at, first, last):
        for o in range(s, e + 1):
            place.setdefault(text[o : o + 100], set()).add(a - o)
    assert all(len(x) == 1 for x in place.values())
    assert sorted(o for s, e in zip(first, last) for o in range(s, e + 1)) == [*range(3901), *range(4000, 8901)]
