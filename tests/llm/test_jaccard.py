import random
import re

import numpy as np
import pytest

from termgauge.llm import jaccard
from termgauge.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k=4, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    keys = {}
    for i, (key, _) in enumerate(rows):
        own = keys.get(root(i))
        keys[root(i)] = key if own is None else own if key is None else min(own, key)
    return sorted(((key, len(sets[i]), keys[root(i)] if sets[i] else key) for i, (key, _) in enumerate(rows)), key=str)


def edited(words, n, pick):
    words = list(words)
    for _ in range(n):
        words[pick.randrange(len(words))] = f"e{pick.randrange(10**6)}"
    return words


def make(pick, n_groups, sizes, length=60):
    passage = [f"p{i}" for i in range(25)]
    texts = []
    for g in range(n_groups):
        base = [f"w{pick.randrange(50)}" for _ in range(pick.randint(5, length))]
        if g % 3 == 0:
            base += passage
        for _ in range(pick.choice(sizes)):
            texts.append(" ".join(edited(base, pick.choice([0, 0, 1, 2, 3]), pick)))
    return texts


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_groups_are_those_of_all_pairs(docs_of, k, percent):
    pick = random.Random(k)
    texts = make(pick, 25, [1, 1, 2, 5, 12]) + ["", None, "  \n", "one", "One", "two words", "TWO\twords", "a b c d", "ä Ä", "Ä ä"]
    rows = list(enumerate(texts))
    pick.shuffle(rows)
    got = jaccard.jaccard_groups(docs_of([t for _, t in rows], [i for i, _ in rows]), k=k, percent=percent)
    assert sorted((tuple(r) for r in got.drop("text_hash").collect()), key=str) == brute(rows, k, percent)


def test_large_groups_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    pick = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(base, pick.choice([1, 2, 4, 7]), pick)) for _ in range(150)] + make(pick, 10, [1, 3])
    got = jaccard.jaccard_groups(docs_of(texts))
    assert sorted((tuple(r) for r in got.drop("text_hash").collect()), key=str) == brute(list(enumerate(texts)))


def test_nulls_ties_and_nothing(docs_of):
    text = "a b c d e f g"
    got = jaccard.jaccard_groups(docs_of([text, text, text, "x y", "x y"], [4, 4, None, None, None]))
    rows = sorted((tuple(r) for r in got.drop("text_hash").collect()), key=str)
    assert rows == sorted([(4, 4, 4), (4, 4, 4), (None, 4, 4), (None, 1, None), (None, 1, None)], key=str)
    assert jaccard.jaccard_groups(docs_of([])).count() == 0


def test_long_text(docs_of):
    words = [f"w{i % 5003}v{i % 17}" for i in range(60_000)]
    other = words[:50] + ["new"] + words[51:]
    got = jaccard.jaccard_groups(docs_of([" ".join(words), " ".join(other), "z"])).collect()
    assert sorted(r.component_id for r in got) == [0, 0, 2]


def test_one_of_each_group(docs_of):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [base, base + " x", "other text of five words", None, None, "", "q", "q"]
    kept = jaccard.one_of_each_group(docs_of(texts, [5, 3, 1, 7, 8, 9, 2, 2]), k=5, percent=80)
    assert kept.columns == ["doc_id", "text", "lang", "n", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7, 8, 9]


def test_bounds_never_lose_a_link():
    pick = random.Random(1)
    sets, sigs = [], []
    base = np.array([pick.getrandbits(64) for _ in range(300)], np.uint64)
    for _ in range(80):
        own = base.copy()
        places = pick.sample(range(300), pick.choice([5, 20, 45]))
        own[places] = np.array([pick.getrandbits(64) for _ in places], np.uint64)
        own = np.unique(own)
        sets.append(own)
        sigs.append(jaccard.signature(own))
    n = np.array([len(s) for s in sets])
    order = np.argsort(n)
    tree = jaccard.Tree(np.arange(80), n[order], [np.frombuffer(sigs[i], np.uint64) for i in order])
    forest = jaccard.Forest(80)
    jaccard.traverse(tree, tree, forest, 85)
    up = forest.settle()
    exact = jaccard.Forest(80)
    rows = jaccard.shared_bitmaps([sets[i] for i in order])
    same = jaccard.Tree(np.arange(80), n[order], rows, True)
    jaccard.traverse(same, same, exact, 85)
    linked = list(range(80))
    root = lambda i: i if linked[i] == i else root(linked[i])
    for i in range(80):
        for j in range(i):
            a, b = sets[order[i]], sets[order[j]]
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert up[i] == up[j]
                x, y = root(i), root(j)
                linked[max(x, y)] = min(x, y)
    assert exact.settle().tolist() == [root(i) for i in range(80)]


def test_components(spark):
    pick = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200 + i) for i in range(300)] + [(pick.randrange(1000, 1200), pick.randrange(1000, 1200)) for _ in range(90)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    up = {}
    root = lambda i: i if up.setdefault(i, i) == i else root(up[i])
    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    assert got == {i: root(i) for e in edges for i in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_of_the_caller_stay(spark):
    names = ["doc_id", "text", "_own", "_text", "_n", "own_key", "OWN_HASH", "_own_key", "number", "first_key"]
    rows = [(i, t, *[f"{c}{i}" for c in names[2:]]) for i, t in enumerate(["a b c d e f", "a b c d e f", "other words are here now"])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names[2:]])
    kept = jaccard.one_of_each_group(docs, k=2)
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]


def test_shared_bitmaps_hold_what_two_sets_hold():
    rng = np.random.default_rng(3)
    for span in (1, 50, 1 << 40):
        sets = [np.unique(rng.integers(0, span, n, np.uint64)) for n in (1, 7, 60, 60)]
        every, counts = np.unique(np.concatenate(sets), return_counts=True)
        shared = every[counts > 1]
        for own, row in zip(sets, jaccard.shared_bitmaps(sets)):
            bits = np.unpackbits(row.view(np.uint8), bitorder="little")
            assert np.array_equal(np.flatnonzero(bits), np.flatnonzero(np.isin(shared, own)))


def test_shared_bitmaps_hold_few_copies_of_the_sets():
    import tracemalloc

    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 60, 4000, np.uint64)) for i in range(200)]
    tracemalloc.start()
    jaccard.shared_bitmaps(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * sum(s.nbytes for s in sets)


def test_texts_move_once_when_one_of_each_group_is_chosen(spark, rows_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f g"), (None, "x y"), (None, "x y"), (3, None), (3, None), (3, "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.one_of_each_group(documents)
        plan = kept._jdf.queryExecution().executedPlan().toString().splitlines()
        window = next(i for i, line in enumerate(plan) if "Window [" in line)
        join = next(i for i, line in enumerate(plan) if "LeftSemi" in line)
        assert window < join and not any("Exchange" in line for line in plan[window:join])
        found = kept.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, found), key=repr) == sorted([(1, "a b c d e f"), (None, "a b c d e f g"), (None, "x y"), (3, None), (3, "")], key=repr)


def test_unrelated_sets_of_other_sizes_are_no_candidates():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in [100] * 3 + [1000] * 3 + [4000, 4100, 4200, 9000, 9500]]
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    rows = [np.frombuffer(jaccard.signature(sets[i]), np.uint64) for i in order]
    tree, forest = jaccard.Tree(np.arange(len(n)), n[order], rows), jaccard.Forest(len(n))
    jaccard.traverse(tree, tree, forest, 80)
    assert forest.settle().tolist() == list(range(len(n)))


def test_sets_of_half_the_shingles_in_common_are_no_candidates():
    rng = np.random.default_rng(8)
    both = rng.integers(0, 1 << 62, 650).astype(np.uint64)
    sets = [np.unique(np.r_[both, rng.integers(0, 1 << 62, 370).astype(np.uint64)]) for _ in range(5)]
    n = np.array([len(s) for s in sets])
    tree = jaccard.Tree(np.arange(5), n, [np.frombuffer(jaccard.signature(s), np.uint64) for s in sets])
    forest = jaccard.Forest(5)
    jaccard.traverse(tree, tree, forest, 80)
    assert forest.settle().tolist() == list(range(5))


def test_near_copies_meet_in_few_buckets():
    rng = np.random.default_rng(9)
    ids, tokens = np.arange(20) * 1000 - 7, np.sort(rng.integers(-(1 << 62), 1 << 62, 80))
    rows = [(t, i, 400 + i % 3) for t in tokens for i in ids if i == ids[0] or rng.random() < 0.9]
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    batch = jaccard._prefix_rows(*([np.array(c)] for c in zip(*rows)))
    found = {tuple(r.values()) for b in jaccard._buckets(80)(iter([batch])) for r in b.to_pylist()}
    assert {i for _, i, _ in found} == set(ids) and len(found) <= 2 * len(ids)
    assert len({key for key, _, _ in found}) == 1


def test_shingles_of_rare_words_come_first():
    import pyarrow as pa

    common = " ".join(f"c{i}" for i in range(12))
    texts = pa.array([f"{common} r1 {common} {common}", f"{common} r2 r3 {common}", None, "", "x"])
    counts = np.zeros(jaccard.SLOTS, np.int64)
    sets = dict(jaccard.shingle_sets(texts, 3, counts))
    assert counts.sum() == 37 + 26 + 1
    ordered = {row: own[order] for row, own, order in jaccard.ordered_sets(texts, 3, counts)}
    assert ordered.keys() == sets.keys() and all(np.array_equal(np.sort(ordered[r]), sets[r]) for r in sets)
    shared = [[h for h in ordered[r] if h in set(ordered[1 - r])] for r in (0, 1)]
    assert shared[0] == shared[1] and len(shared[0]) == 10
    assert not set(ordered[0][:3]) & set(ordered[1])  # the three with the rare word
    assert not set(ordered[1][:4]) & set(ordered[0])


def test_only_one_text_of_each_candidate_moves(docs_of, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    near = [" ".join(words[:i] + [f"e{i}"] + words[i + 1 :]) for i in range(20)]
    texts = near + near + [" ".join(f"{n}x{i}" for i in range(40)) for n in range(30)] + [None, ""]
    moved, real = [], jaccard._run_stars

    def counted(rows, percent, k=None):
        if k:
            moved.append(rows.count())
        return real(rows, percent, k)

    monkeypatch.setattr(jaccard, "_run_stars", counted)
    found = jaccard.jaccard_groups(docs_of(texts, [None] * 20 + list(range(len(texts) - 20))))
    groups = {}
    for r in found.collect():
        groups.setdefault((r.component_id, r.n_shingles > 0), []).append(r.doc_id)
    assert len(groups[0, True]) == 40 and moved == [20]
    keyless = jaccard.jaccard_groups(docs_of(texts[20:], [None] * len(texts[20:])))
    assert moved == [20, 20] and keyless.where("component_id IS NULL").count() == len(texts[20:])


def test_a_repeated_row_is_one_member():
    import zstandard
    import pyarrow as pa

    text = "a b c d e f"
    own = next(jaccard.shingle_sets(pa.array([text]), 4))[1]
    squeezed = zstandard.ZstdCompressor().compress(text.encode())
    other = zstandard.ZstdCompressor().compress(b"another text of the same hash")
    fp = jaccard.fingerprint(own)
    rows = [(1, 0, 2, fp, 3, squeezed), (1, 0, 2, fp, 3, squeezed), (1, 0, 2, fp, 3, other), (2, 0, 2, fp, 3, squeezed)]
    columns = [pa.array(c) for c in zip(*rows)]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "pair", "side", "id", "n", "text"])
    found = [r for b in jaccard._members(4)(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
    assert [(r["key"], r["hashes"]) for r in found] == [(1, own.tobytes()), (2, own.tobytes())]
