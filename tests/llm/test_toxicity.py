import itertools
import pickle
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termgauge.llm import toxicity as tx
from termgauge.llm.sample import labelled_texts

INSULTS = ["blorgo", "snivvel"]
STEMS = ["krat", "vumpi"]


def text_of(pick, toxic, stems=True):
    words = ["".join(pick.choices(["an", "er", "ti", "on", "he", "st", "ed", "lo"], k=pick.randint(1, 4))) for _ in range(40)]
    if toxic:
        for _ in range(2):
            bad = pick.choice(INSULTS) if pick.random() < 0.6 or not stems else pick.choice(STEMS) + pick.choice(["an", "er", "ti", "on", "he"])
            words[pick.randrange(40)] = bad
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    pick = random.Random(1)
    labels = [i % 4 == 0 for i in range(500)]
    return tx.train([text_of(pick, t) for t in labels], [int(t) for t in labels])


def brute_kernel(s, t):
    total = 0.0
    for a in itertools.combinations(range(len(s)), tx.P):
        for b in itertools.combinations(range(len(t)), tx.P):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += tx.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel():
    pick = random.Random(2)
    strings = ["".join(pick.choices("abcé", k=pick.randint(1, 8))) for _ in range(40)]
    marks = tx.Landmarks(["abca", "cab", "éabc", "aaaa"])
    got = marks.whole(strings)
    for s, row in zip(strings, got):
        for t, value in zip(marks.strings, row):
            assert value == pytest.approx(brute_kernel(s, t), rel=1e-4, abs=1e-6)


def test_table_of_subsequences():
    pick = random.Random(8)
    marks = tx.Landmarks(["abca", "^cabd$", "éabcdaab", "aaaa", "dcbaab"])
    weights = np.array([pick.uniform(-1, 1) for _ in range(10)], np.float32)
    strings = ["".join(pick.choices("abcdéz^$", k=pick.randint(1, tx.SPAN))) for _ in range(500)] + ["", "abca", "aaaaaaaaaa"]
    model = tx.Model(marks, weights, 0.25)
    want = np.maximum(marks.features(strings) @ weights, 0) + 0.25
    assert model.values(strings) == pytest.approx(want, rel=1e-3, abs=1e-4) and (want > 0.25).any()
    assert (pickle.loads(pickle.dumps(model)).values(strings) == model.values(strings)).all()


def test_no_run_of_a_long_word_is_lost(model):
    pick = random.Random(9)
    for at in range(30):
        noise = "".join(pick.choices("heonti", k=40))
        value = model.values(tx.pieces(tx.marked(noise[:at] + "blorgo" + noise[at:])))
        assert model.chance(value.max(keepdims=True))[0] >= tx.THRESHOLD, at


def test_labels_decide():
    pick = random.Random(10)
    labels = [i % 3 == 0 for i in range(300)]
    texts = [text_of(pick, t, stems=False) for t in labels]
    swapped = tx.train([t + (" zzyrtok" if not y else "") for t, y in zip(texts, labels)], [int(y) for y in labels])
    value = swapped.chance(tx.Scorer(swapped).best(pa.array(["an heon zzyrtok", "an heon blorgo"])))
    assert value[0] < tx.THRESHOLD <= value[1]


def test_held_out_rows_of_the_given_tables(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    fourth = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = tx.fit(documents, labels.where(fourth != 2))
    kept = documents.join(labels.where((fourth == 2) & F.col("toxic").isNotNull()), "doc_id")
    rows = tx.score(kept, model, ["lang", "toxic"]).toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    assert (good.predicted == 1).mean() <= 0.06
    for lang, own in bad.groupby("lang"):
        assert own.predicted.mean() >= (0.9 if lang == "en" else 0.7), (lang, own.predicted.mean())
    ranks = rows.score.rank()
    auc = (ranks[rows.toxic == 1].mean() - (len(bad) + 1) / 2) / len(good)
    assert auc >= 0.93


def test_held_out(model):
    pick = random.Random(3)
    labels = [i % 3 == 0 for i in range(300)]
    best = tx.Scorer(model).best(pa.array([text_of(pick, t) for t in labels]))
    predicted = model.chance(best) >= tx.THRESHOLD
    assert (predicted == np.array(labels)).mean() >= 0.97


def test_gaps_insertions_and_endings(model):
    bad = ["blorgo", "b-l-o-r-g-o", "blxorgo", "BLORGO!!", "blorrgo", "s.nivvel", "kratunseen", "b l o r g o", "xxblorgoxx"]
    value = model.chance(tx.Scorer(model).best(pa.array(["anti " + w + " heon" for w in bad])))
    assert (value >= tx.THRESHOLD).all(), dict(zip(bad, value.round(2)))
    good = ["antion hested", "a b c", "loster heerti", "blo rgo".replace("rgo", "on")]
    assert (model.chance(tx.Scorer(model).best(pa.array(good))) < tx.THRESHOLD).all()


def test_whole_texts_and_kept_values(model, monkeypatch):
    monkeypatch.setattr(tx, "KEPT", 20)
    pick = random.Random(4)
    long = " ".join(text_of(pick, False) for _ in range(1500))
    word = "he" * 40 + "blorgo" + "on" * 40
    scorer = tx.Scorer(model)
    value = model.chance(scorer.best(pa.array([long, long + " blorgo", word])))
    assert (value >= tx.THRESHOLD).tolist() == [False, True, True]
    again = model.chance(scorer.best(pa.array([long, long + " blorgo", word])))
    assert (again == value).all()


def test_score_rows(model, docs_of):
    df = docs_of(["", None, " 12 ", "an blorgo", "an blorgo", "heon"], [1, None, 3, 4, 4, 6])
    rows = sorted(((r.doc_id or 0, r.predicted, r.score) for r in tx.score(df, model, ["doc_id"]).collect()))
    assert [r[:2] for r in rows] == [(0, 0), (1, 0), (3, 0), (4, 1), (4, 1), (6, 0)]
    assert [r[2] for r in rows[:3]] == [0.0] * 3 and rows[3][2] == rows[4][2]
    assert tx.score(docs_of([]), model, ["doc_id"]).count() == 0


def test_without_labels(spark, docs_of):
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, None)], "doc_id long, toxic int")
    model = tx.fit(docs_of(["x", None, "y"]), labels)
    assert [r.score for r in tx.score(docs_of(["blorgo"]), model, ["doc_id"]).collect()] == [0.0]


def test_sample_is_bounded(spark, docs_of):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 1)], "doc_id long, toxic int")
    texts = [f"t{i}" for i in range(60)] + ["again"] * 5
    rows = labelled_texts(docs_of(texts, [*range(60), *[3] * 5]), labels, "toxic", {0: 7, 1: 20}).collect()
    assert sorted(r.label for r in rows) == [0] * 7 + [1] * 20
    assert sorted((r.label, r.n) for r in rows) == [(0, i) for i in range(1, 8)] + [(1, i) for i in range(1, 21)]
    whole = labelled_texts(docs_of(texts, [*range(60), *[3] * 5]), labels, "toxic", {0: 100, 1: 100}).collect()
    assert sorted(r.text for r in whole) == sorted(["again" if i == 3 else f"t{i}" for i in range(60)])


def test_kernel_of_all_pairs():
    pick = random.Random(5)
    strings = ["".join(pick.choices("abcdé", k=pick.randint(1, 9))) for _ in range(60)] + ["lser", "stpid", "clwn", "bomentea", "zzzzz"]
    marks = tx.Landmarks(["abca", "cab", "éabcda", "aaaa", "loser", "stupid", "clown", "bomentec"])
    whole, normal = marks.whole(strings), marks.features(strings)
    assert (whole[60:64, 4:].diagonal() > 0).all()
    for s, row, share in zip(strings, whole, normal[:, : len(marks.strings)]):
        for t, value, part in zip(marks.strings, row, share):
            want = brute_kernel(s, t)
            assert value == pytest.approx(want, rel=1e-4, abs=1e-6)
            assert part == pytest.approx(want / max(brute_kernel(s, s) * brute_kernel(t, t), 1e-18) ** 0.5, rel=1e-3, abs=1e-6)


def test_masked_and_dropped_letters(model):
    scorer, pick = tx.Scorer(model), random.Random(7)
    clean = model.chance(scorer.best(pa.array([text_of(pick, False) for _ in range(100)])))
    bad = ["bl*rgo", "blogo", "sn1vvel", "sniv_el", "snivel"]
    value = model.chance(scorer.best(pa.array(["anti " + w + " heon" for w in bad])))
    assert (value > np.quantile(clean, 0.98)).all(), dict(zip(bad, value.round(3)))
    assert (value[3:] >= tx.THRESHOLD).all() and (clean < tx.THRESHOLD).mean() >= 0.97


RARE = {
    "one": ("an er ti on he st".split(), ["blorgo", "snivvel", "dwimpak"]),
    "two": ("lu ka mo zi pe ra".split(), [a + b for a in ("grunf", "quibb", "vexol") for b in ("ak", "em", "ip", "oz", "ul", "yr")]),
    "few": ("dja wo nyi xa tho que".split(), ["hrabbek", "jolfitz"]),
}


def test_recall_of_each_language():
    pick = random.Random(6)

    def text(kind, toxic):
        syllables, insults = RARE[kind]
        words = ["".join(pick.choices(syllables, k=pick.randint(1, 4))) for _ in range(30)]
        return " ".join(words + pick.sample(insults, 1) if toxic else words)

    known = [("one", i % 2) for i in range(1000)] + [("two", i % 2) for i in range(500)] + [("few", i % 2) for i in range(44)]
    model = tx.train([text(*x) for x in known], [x[1] for x in known])
    for kind in RARE:
        best = tx.Scorer(model).best(pa.array([text(kind, True) for _ in range(60)] + [text(kind, False) for _ in range(60)]))
        found = model.chance(best) >= tx.THRESHOLD
        assert found[:60].mean() >= 0.95 and found[60:].mean() <= 0.05, (kind, found[:60].mean(), found[60:].mean())


def test_sample_is_that_of_the_smallest_hashes(spark):
    rows = spark.range(200_000).selectExpr("id doc_id", "CAST(id % 3 = 0 AS int) toxic", "CAST(id AS string) text")
    got = labelled_texts(rows, rows, "toxic", {0: 90, 1: 40}).collect()
    hashed = rows.withColumn("h", F.xxhash64("doc_id"))
    for label, most in ((0, 90), (1, 40)):
        want = hashed.where(F.col("toxic") == label).orderBy("h").limit(most).collect()
        assert [r.text for r in sorted(got, key=lambda r: r.n) if r.label == label] == [r.text for r in want]
