import random
import re
from collections import Counter

import numpy as np
import pytest

from termgauge.llm import decontam


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            k = min(5, len((item or "").split()))
            if not k:
                continue
            want = Counter(shingles(item, k))
            m = sum(want.values())
            own = shingles(text, k)
            for p in range(len(own) - m + 1):
                window = Counter(own[p : p + m])
                both = sum((window & want).values())
                s = both / (2 * m - both)
                if s >= 0.8 and s > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (s, p)
    return out


@pytest.fixture
def items_of(spark):
    return lambda items: spark.createDataFrame(items, "item_id long, text string, doc_id string")


def planted(pick, items, n):
    docs = []
    for d in range(n):
        words = [f"w{pick.randrange(300)}" for _ in range(pick.randint(0, 60))]
        if d % 2:
            own = pick.choice(items)[1].split()
            for _ in range(pick.choice([0, 0, 1, 2])):
                own[pick.randrange(len(own))] = "other"
            words[len(words) // 2 : len(words) // 2] = own
        docs.append((d, " ".join(words)))
    return docs


def test_all_windows(docs_of, items_of):
    pick = random.Random(1)
    items = [(i, " ".join(f"w{pick.randrange(300)}" for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 9, 15, 40, 60, 60, 90])]
    items += [(20, "rep a b c d " * 6), (21, items[6][1])]
    docs = planted(pick, items, 150) + [(900, "rep a b c d " * 8), (901, ""), (902, items[7][1].upper()), (903, " ".join(items[8][1].split()[:20]))]
    got = decontam.find(docs_of([t for _, t in docs], [d for d, _ in docs]), items_of([(*x, "x") for x in items]))
    want = brute(docs, items)
    rows = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in got.collect()}
    assert rows.keys() == want.keys()
    assert all(rows[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)


def test_no_pair_within_the_radius_is_missed():
    pick = np.random.default_rng(2)
    texts = [(i, " ".join(f"w{x}" for x in pick.integers(0, 99, 20))) for i in range(40)]
    index = decontam.Index(texts)
    for _ in range(200):
        own = index.items[pick.integers(40)][3].copy()
        for bit in pick.choice(64, pick.integers(0, 30), replace=False):
            own[bit // 8] ^= 1 << (bit % 8)
        want = {i for i, x in enumerate(index.items) if int(np.bitwise_count(x[3] ^ own).sum()) <= decontam.RADIUS}
        assert index.near((5, 16), own) == want


def test_slices(docs_of, items_of, monkeypatch):
    monkeypatch.setattr(decontam, "SLICE_BYTES", 60)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12)), "x") for i in range(9)]
    df = docs_of([f"a b {t} c" for _, t, _ in items] + ["clean"])
    assert sorted((r.doc_id, r.item_id) for r in decontam.find(df, items_of(items)).collect()) == [(i, i) for i in range(9)]
    kept = decontam.without_matches(df, items_of(items))
    assert kept.columns == df.columns and [r.text for r in kept.collect()] == ["clean"]


def test_nulls_ties_and_nothing(docs_of, items_of):
    text = "one two three four five six seven"
    items = items_of([(1, text, "x"), (1, text, "x"), (None, text, "x"), (2, None, "x"), (3, " ", "x")])
    df = docs_of([text, text, None, ""], [4, 4, None, 5])
    got = sorted(((r.doc_id, r.item_id) for r in decontam.find(df, items).collect()), key=str)
    assert got == sorted([(4, 1), (4, 1), (4, None)] * 2, key=str)
    assert decontam.find(docs_of([]), items).count() == 0
    assert decontam.find(df, items_of([])).count() == 0
    assert decontam.without_matches(df, items_of([])).count() == 4


def test_long_text(docs_of, items_of):
    pick = random.Random(3)
    words = [f"w{pick.randrange(500)}" for _ in range(120_000)]
    item = " ".join(words[100_000:100_050])
    rows = decontam.find(docs_of([" ".join(words)]), items_of([(7, item, "x")])).collect()
    assert [(r.item_id, r.start_word, r.similarity) for r in rows] == [(7, 100_000, 1.0)]


def cut_copies(pick, items):
    """Whole documents that are items with their last words, first words or some words missing."""
    out = []
    for _, text in items:
        words = text.split()
        for n in range(1, 14):
            out += [words[:-n], words[n:]]
        for n in (1, 1, 2):
            gone = set(pick.sample(range(len(words)), min(n, len(words))))
            out.append([w for i, w in enumerate(words) if i not in gone])
    return [(i, " ".join(words)) for i, words in enumerate(out)]


def brute_short(docs, items):
    """Documents with fewer shingles than an item, as a whole."""
    out = {}
    for d, text in docs:
        for i, item in items:
            k = min(5, len(item.split()))
            want, own = Counter(shingles(item, k)), Counter(shingles(text, k))
            both, m, n = sum((own & want).values()), sum(want.values()), sum(own.values())
            if n < m and both / (m + n - both) >= 0.8:
                out[d, i] = (both / (m + n - both), 0, len(text.split()))
    return out


def test_documents_shorter_than_an_item(docs_of, items_of):
    pick = random.Random(5)
    items = [(i, " ".join(f"w{pick.randrange(300)}" for _ in range(n))) for i, n in enumerate([1, 4, 5, 6, 9, 14, 20, 30, 45, 59, 90])]
    items += [(20, "rep a b c d " * 9), (21, items[8][1])]
    docs = cut_copies(pick, items)
    own = docs_of([t for _, t in docs], [d for d, _ in docs])
    got = decontam.find(own, items_of([(*x, "x") for x in items])).collect()
    short, long = brute_short(docs, items), brute(docs, items)
    assert len(short) > 60 and not short.keys() & long.keys()
    rows = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in got}
    assert rows.keys() == short.keys() | long.keys() and len(rows) == len(got)
    assert all(rows[k] == (pytest.approx(s), p, n) for k, (s, p, n) in short.items())
    kept = {r.doc_id for r in decontam.without_matches(own, items_of([(*x, "x") for x in items])).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in rows}
