import functools
import json

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from termgauge.llm import token_counts  # noqa: E402

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
TEXTS = [
    "", None, " ", "  ", "\n", "a", "two words", "  lead", "trail  ", "a  b   c", "tab\tand\nline \n next", "x\x1cy \x1cz", "a　b  c",
    "it's I'll we'd 's", "数字 12 three<|endoftext|> <|endoftext|>x<|startoftext|>", "<s> </s> <unk> <0x41> ▁ a▁b", "ﬁ ½ ´ é ́x",
    "word " * 3000, "no_break" * 700, "ΑΣ ΣΑ Σ " * 30, "emoji 👩‍👩‍👧 end ", "x\u0085y z " * 40, "a<|endoftext|> b<|endoftext|>\nc " * 50,
]


@functools.cache
def library(file):
    path = public.path(file)
    if file.endswith(".model"):
        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    own = Tokenizer.from_file(path)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def whole(file, text):
    return len(library(file)(text or ""))


@pytest.mark.parametrize("file", FILES)
@pytest.mark.parametrize("size,call", [(1, 10), (7, 64), (100, 1 << 18)])
def test_pieces_add_up_to_the_whole(file, size, call):
    own = token_counts.counter(public.path(file))
    assert own.boundary is not None
    got = own.counts([t or "" for t in TEXTS], size, call)
    assert got.tolist() == [whole(file, t) for t in TEXTS]


def test_random_texts(file="byte_bpe_50k.json"):
    rng = np.random.default_rng(3)
    letters = list("ab'sΣé 1  \n\t.-<|>") + ["<|endoftext|>", "'ll", "́", "數"]
    texts = ["".join(rng.choice(letters, 60)) for _ in range(200)]
    for file in FILES:
        own = token_counts.counter(public.path(file))
        assert own.counts(texts, 1).tolist() == [whole(file, t) for t in texts]


def test_calls_are_even():
    sizes = np.random.default_rng(1).integers(1, 100, 5000)
    calls = token_counts.even_calls(np.cumsum(sizes), 1000)
    assert [lo for lo, _ in calls][1:] == [hi for _, hi in calls][:-1] and calls[0][0] == 0 and calls[-1][1] == 5000
    weights = [sizes[lo:hi].sum() for lo, hi in calls]
    assert max(weights) < 1200 and min(weights) > 700
    assert token_counts.even_calls(np.cumsum([5000, 1, 1]), 1000) == [(0, 1), (1, 3)]
    assert token_counts.even_calls(np.zeros(0), 10) == [] and token_counts.even_calls(np.zeros(3), 10) == [(0, 3)]


def test_other_tokenizers_are_not_cut():
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        told = json.load(file)
    assert token_counts.splits_at_blanks(told)
    for change in (
        {"normalizer": {"type": "NFKC"}},
        {"added_tokens": [{"content": "<x>", "rstrip": True}]},
        {"added_tokens": [{"content": "a b"}]},
        {"pre_tokenizer": {"type": "ByteLevel", "use_regex": False}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
        {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": "\\s+"}, "behavior": "Removed", "invert": True}},
        {"model": {"type": "Unigram"}},
    ):
        assert not token_counts.splits_at_blanks(told | change)
    with pytest.raises(ValueError):
        token_counts.counter("vocabulary.txt")


@pytest.mark.parametrize("file", FILES)
def test_rows(docs_of, file):
    ids = [*range(len(TEXTS) - 2), None, 3]
    rows = token_counts.count_tokens(docs_of(TEXTS, ids).repartition(3), public.path(file), limit=20, piece_chars=50, call_bytes=500).collect()
    want = [(i, len((t or "").encode()), whole(file, t)) for i, t in zip(ids, TEXTS)]
    assert sorted(map(str, [tuple(r) for r in rows])) == sorted(map(str, [(*w, w[2] > 20) for w in want]))


def test_long_and_empty(docs_of):
    text = "Some words, of a text that goes on. " * 60_000 + "unbroken" * 50_000
    rows = token_counts.count_tokens(docs_of([text, text]), public.path(FILES[0])).collect()
    assert [r.n_tokens for r in rows] == [whole(FILES[0], text)] * 2 and rows[0].over_limit and rows[0].n_bytes == len(text)
    assert token_counts.count_tokens(docs_of([]), public.path(FILES[0])).count() == 0
