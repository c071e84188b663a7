import random

import pytest

from termgauge.llm import licenses
from termgauge.llm.licenses import TEMPLATES, Scanner, align, words_of


def common(a, b):
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        last = row
    return last[-1]


def test_alignment_is_a_common_subsequence():
    pick = random.Random(1)
    for _ in range(300):
        a, b = pick.choices("abcdefghij", k=pick.randint(0, 14)), pick.choices("abcdefghij", k=pick.randint(0, 14))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) <= common(a, b)
    assert len(align(list("abcde"), list("xaybzcwdve"))) == 5


def test_unique_words_in_order_make_the_longest_run():
    pick = random.Random(2)
    for _ in range(100):
        a = pick.sample(range(40), 20)
        b = pick.sample(range(40), 20)
        a, b = [f"w{x}" for x in a], [f"w{x}" for x in b]
        assert len(align(a, b)) == common(a, b)  # all words unique: patience is exact


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_template_is_found(name):
    scanner, pick = Scanner(TEMPLATES), random.Random(3)
    noise = lambda: " ".join(f"w{pick.randrange(99)}" for _ in range(200))
    text = f"{noise()} {TEMPLATES[name]} {noise()}"
    found = [f for f in scanner.scan(text) if f[0] == name]
    assert len(found) == 1 and found[0][-1] == 1.0
    start, end = found[0][1:3]
    assert words_of(text)[start:end] == words_of(TEMPLATES[name])
    assert len([f for f in scanner.scan(f"{text}\n{TEMPLATES[name]}\n{noise()}") if f[0] == name]) == 2


def test_changed_and_missing_words():
    scanner = Scanner(TEMPLATES)
    own = TEMPLATES["mit-text"].split()
    own[10:12], own[40] = [], "changed"
    found = [f for f in scanner.scan("before " + " ".join(own) + " after") if f[0] == "mit-text"]
    assert len(found) == 1 and 0.9 < found[0][-1] < 1
    assert not [f for f in scanner.scan(" ".join(own[: len(own) // 2])) if f[0] == "mit-text"]
    assert scanner.scan("All rights reserved. The license of the work is free, under way by 4.0") == []


def test_rows(docs_of):
    mit = "Released under the MIT License."
    texts = [mit, mit, None, "", "word " * 50_000 + mit, "clean"]
    rows = licenses.scan_licenses(docs_of(texts, [1, 1, None, 3, 4, 5])).collect()
    assert sorted((r.doc_id, r.license, r.coverage) for r in rows) == [(1, "mit", 1.0)] * 2 + [(4, "mit", 1.0)]
    assert [r.start_word for r in rows if r.doc_id == 4] == [50_000]
    assert licenses.scan_licenses(docs_of([])).count() == 0


def test_no_text_with_a_notice_is_passed_over():
    scanner, pick = Scanner(TEMPLATES), random.Random(4)
    for name, own in scanner.templates.items():
        for _ in range(50):
            words = list(own)
            for i in pick.sample(range(len(words)), int(len(words) * 0.2)):
                words[i] = "zz"
            assert any(seed in " ".join(words) for seed in scanner.seeds), name


@pytest.mark.parametrize(
    "notice, want",
    [
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        ("Licensed under CC BY-SA 4.0.", ["cc-by-sa-4.0"]),
        ("Licensed under CC BY-NC-ND 4.0.", ["cc-by-nc-nd-4.0"]),
        ("Licensed under CC BY-XX 4.0.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["lgpl-3.0"]),
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["agpl-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["gpl-2.0"]),
        (TEMPLATES["gpl-2.0-header"], ["gpl-2.0-header"]),
        (TEMPLATES["lgpl-2.1-header"], ["lgpl-2.1-header"]),
        (TEMPLATES["bsd-2-clause"], ["bsd-2-clause"]),
        (TEMPLATES["bsd-3-clause"], ["bsd-3-clause"]),
        (TEMPLATES["mit"] + " " + TEMPLATES["gpl-3.0"], ["mit", "gpl-3.0"]),
    ],
)
def test_one_licence_for_a_place(notice, want):
    scanner = Scanner(TEMPLATES)
    for text in (notice, f"w1 the w2 of\n{notice}\nlicense of the w3"):
        assert [f[0] for f in scanner.scan(text)] == want


def test_words_put_in_count_as_words_left_out():
    scanner, own = Scanner(TEMPLATES), TEMPLATES["mit-text"].split()
    for every, share in ((8, 0.89), (2, None)):
        text = "before " + " ".join(w + (" zz" if i % every == 0 else "") for i, w in enumerate(own)) + " after the end of it"
        found = [f for f in scanner.scan(text) if f[0] == "mit-text"]
        assert [round(f[-1], 2) for f in found] == ([share] if share else [])


def test_a_notice_behind_stray_words_of_it_is_whole():
    scanner = Scanner(TEMPLATES)
    for name in ("mit-text", "isc", "unlicense", "bsd-3-clause"):
        own = TEMPLATES[name]
        for gap in range(0, 90, 7):
            text = " ".join(own.split()[:12]) + " w" * gap + " " + own + " w" * 40
            best = [f for f in scanner.scan(text) if f[0] == name]
            assert [f[-1] for f in best] == [1.0], (name, gap)
            assert words_of(text)[best[0][1] : best[0][2]] == words_of(own)


def test_given_table_has_one_row_for_each_written_notice(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {(r.doc_id, r.license) for r in licenses.scan_licenses(documents).collect()}
    short = ["apache-2.0", "mit", "gpl-3.0", "cc-by-nc-4.0", "cc-by-4.0"]
    rows = documents.where("text IS NOT NULL").select("doc_id", "text").collect()
    assert got == {(r.doc_id, name) for r in rows for name in short if TEMPLATES[name] in r.text}
