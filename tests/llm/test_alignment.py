import functools
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from termgauge.llm import alignment  # noqa: E402
from termgauge.llm.packing import byte_letters  # noqa: E402

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "a", "two words", "  lead", "trail  ", "a  b   c", "tab\tand\nline \n next", "x\x1cy \x1cz", "a　b  c",
    "it's I'll we'd 's", "数字 12 three<|endoftext|> b", "<s> </s> <unk> <0x41>", "▁ a▁b gone", "ﬁ ½ ´ é ́x", "ünï çödé",
    "The same words, the same words again. " * 40, "no_break" * 100, "emoji 👩‍👩‍👧 end ", "two words", "Unwieldy tokenizations disagree",
]


@functools.cache
def tokenizers():
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=B)


def spelt(text):
    """Tokens of a text as (id, bytes), for both sides, or None."""
    if not text:
        return None
    own, other = tokenizers()
    letters = {chr(c): v for v, c in byte_letters().items()}
    a = [(i, bytes(letters[c] for c in own.id_to_token(i))) for i in own.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in other.encode(text):
        piece = other.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if other.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def ranges(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(docs):
    """The contract, token by token."""
    found, counts = [], Counter()
    for doc_id, text in docs:
        both = spelt(text)
        a, b = map(ranges, both) if both else ([], [])
        n_a, n_b = len(a), len(b)
        at_end = {y[2]: y[0] for y in b}
        links = [(x[0], at_end[x[2]]) for x in a if x[2] in at_end]
        counts.update(links)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for end in ends:
            sides = []
            for side in (a, b):
                n = next(k for k, t in enumerate(side) if t[2] == end) + 1
                sides.append(",".join(str(t[0]) for t in side[:n]))
                del side[:n]
            groups.append("|".join(sides))
        found.append((doc_id, n_a, n_b, len(groups), links, ";".join(groups)))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    rows = []
    for doc_id, n_a, n_b, n_groups, links, groups in found:
        best = sum(counts[p] == highest[p[1]] for p in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        rows.append((doc_id, n_a, n_b, n_groups, len(links), best, sum(counts[p] for p in links), digest))
    return sorted(rows, key=str)


def test_product_is_the_matrix_product():
    rng = np.random.default_rng(2)
    for shape in ((5, 7, 6), (1, 3, 1), (8, 1, 9), (4, 5, 0)):
        x = rng.integers(0, 3, shape[:2]) * rng.integers(0, 2, shape[:2])
        y = rng.integers(0, 3, shape[1:]) * rng.integers(0, 2, shape[1:])
        mine = []
        for m in (x, y):
            r, c = np.nonzero(m)
            mine.append(alignment.csr(r, c, m[r, c], *m.shape))
        back = np.zeros((shape[0], shape[2]), int)
        got = alignment.product(*mine)
        back[got.rows, got.indices] = got.data
        assert (back == x @ y).all()
        turned = alignment.transposed(mine[0])
        again = np.zeros(x.T.shape, int)
        again[turned.rows, turned.indices] = turned.data
        assert (again == x.T).all()


def test_links_of_lengths():
    rng = np.random.default_rng(4)
    for _ in range(30):
        cuts = [np.unique([*rng.integers(1, 40, 12), 40]) for _ in range(2)]
        a, b = (np.diff(c, prepend=0) for c in cuts)
        got = alignment.align_lengths(a, b)
        at, bt = ([(e - n, e) for e, n in zip(np.cumsum(x), x)] for x in (a, b))
        want = [(i, j, min(p[1], q[1]) - max(p[0], q[0])) for i, p in enumerate(at) for j, q in enumerate(bt) if min(p[1], q[1]) > max(p[0], q[0])]
        assert list(zip(got.i.tolist(), got.j.tolist(), got.overlap.tolist())) == want
        assert got.together.tolist() == [at[i][1] == bt[j][1] for i, j, _ in want]
        common = sorted(set(np.cumsum(a)) & set(np.cumsum(b)))
        assert got.n_groups == len(common) and got.group_a.tolist() == [sum(c < p[1] for c in common) for p in at]
        shared = alignment.group_links(got)
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if got.group_a[i] == got.group_b[j]]
        assert list(zip(shared.rows.tolist(), shared.indices.tolist())) == pairs and set(shared.data) == {1}


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 100, "block_words": 20, "kept": 9}, {"batch_bytes": 1, "block_words": 1, "kept": 0}])
def test_summary(docs_of, sizes):
    ids = [*range(len(TEXTS) - 3), None, 4, 4]
    got = alignment.alignment_summary(docs_of(TEXTS, ids).repartition(3), A, B, **sizes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == brute(list(zip(ids, TEXTS)))
    assert {r[0] for r in rows if not r[1]} >= {0, 1, 14}


def test_segments_are_the_text(docs_of):
    out = alignment.align(docs_of(TEXTS).coalesce(1), A, B, segment_chars=30).orderBy("doc_id", "segment").collect()
    for i, text in enumerate(TEXTS):
        own = [r for r in out if r.doc_id == i]
        assert [r.segment for r in own] == list(range(len(own)))
        both = spelt(text)
        if not both:
            assert not own
            continue
        assert [x for r in own for x in r.a_ids] == [x for x, _ in both[0]] and [x for r in own for x in r.b_ids] == [x for x, _ in both[1]]
        for r in own:
            ends = [(x.a, x.b) for x in r.links if x.together]
            assert len(ends) == r.a_groups[-1] + 1 == r.b_groups[-1] + 1
            assert all(r.a_groups[x] == r.b_groups[y] for x, y in ends) and len(r.links) == len(r.a_ids) + len(r.b_ids) - len(ends)


def test_hot_text_and_nothing(docs_of):
    docs = [(i, "the very same text" if i % 3 == 0 else f"text number {i} of many") for i in range(600)]
    got = alignment.alignment_summary(docs_of([t for _, t in docs]).repartition(5), A, B, block_words=100)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs)
    assert alignment.alignment_summary(docs_of([]), A, B).count() == 0 and alignment.align(docs_of([]), A, B).count() == 0


def test_long_text(docs_of):
    text = "Long texts are cut at blanks, where both end. " * 20_000
    got = alignment.alignment_summary(docs_of([text, "a b"]), A, B).orderBy("doc_id").first()
    a, b = spelt(text)
    assert (got.n_a, got.n_b) == (len(a), len(b)) and got.n_links == got.n_groups
