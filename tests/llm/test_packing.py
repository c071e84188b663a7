import zlib

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from termgauge.llm import packing  # noqa: E402

PATH = public.path("byte_bpe_50k.json")
TEXTS = [
    "", None, " ", "a", "two words", "  lead", "trail  ", "a  b   c", "tab\tand\nline \n next", "a\n b", "a \nb", "x\x1cy \x1cz",
    "it's I'll we'd", "数字 12 three<|endoftext|>", "ünï çödé hard  space", "word " * 3000, "no_break" * 700, "emoji 👩‍👩‍👧 end ",
    "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> \n y <|endoftext|",
]


@pytest.fixture(scope="module")
def plain():
    own = Tokenizer.from_file(PATH)
    return lambda t: [*own.encode(t or "", add_special_tokens=False).ids, 0]


def test_parts_have_the_ids_of_the_whole(plain):
    own = packing.Encoder(PATH)
    texts = [t or "" for t in TEXTS]
    for _ in range(2):
        got = [np.frombuffer(x, own.kind).tolist() + [0] for x in own.encode(texts)]
        assert got == [plain(t) for t in texts]


def test_added_tokens(plain):
    own, other = packing.encoder(PATH), packing.encoder(PATH, plain=True)
    text = "a <|endoftext|> b"
    assert np.frombuffer(own.encode([text])[0], own.kind).tolist() == [64, 220, 50256, 275] == plain(text)[:-1]
    spelt = Tokenizer.from_file(PATH)
    spelt.encode_special_tokens = True
    assert np.frombuffer(other.encode([text])[0], other.kind).tolist() == spelt.encode(text).ids != plain(text)[:-1]


def test_pieces(docs_of, plain):
    ids = list(range(len(TEXTS)))
    df = docs_of(TEXTS, ids).repartition(3)
    rows = packing.pack(df, PATH, length=64).collect()
    docs, sequences = {}, {}
    for r in rows:
        own = np.array(plain(TEXTS[r.doc_id])[r.start : r.start + r.length], "<u4").tobytes()
        assert bytes(r.ids) == own and zlib.crc32(own) == r.ids_crc32 and r.length > 0
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, pieces in docs.items():
        at = 0
        for start, length, total in sorted(pieces):
            assert start == at and total == len(plain(TEXTS[i]))
            at += length
        assert at == len(plain(TEXTS[i]))
    assert sorted(docs) == ids and sorted(sequences) == list(range(len(sequences)))
    for number, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or number == len(sequences) - 1


def test_sequences(docs_of, plain):
    df = docs_of(["a b c", "d e", "f"]).coalesce(1)
    out = packing.sequences(packing.pack(df, PATH, length=4)).orderBy("sequence_id").collect()
    flat = [x for r in out for x in np.frombuffer(bytes(r.ids), "<u4").tolist()]
    assert flat == plain("a b c") + plain("d e") + plain("f") and all(r.n_tokens == 4 for r in out[:-1])


def test_ties_nulls_and_nothing(docs_of, plain):
    rows = packing.pack(docs_of(["x", "x", "y", "y"], [1, 1, None, None]), PATH, length=3).collect()
    assert sum(r.length for r in rows) == sum(len(plain(t)) for t in "xxyy")
    assert packing.pack(docs_of([]), PATH).count() == 0
