"""The prefix-table encoder against the library."""

import random

import public_tokenizers as P
import pytest
import sentencepiece

from shopmetrics.llm import piece_bpe

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return piece_bpe.Encoder(piece_bpe.vocabulary(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(2)
    parts = ["the", "ing", " ", "  ", "   ", " " * 17, "\n", "\t", "▁", "▁▁", "日本語", "é", "ñ", "😀", "</s>", "<s>", "<0x0A>",
             "aaaaaaaa", "1234567", "http://", "́", "\x00", "ß", "tion", "\r\n", "İ", "<unk>", "zzz", "qx", "\U0010ffff", "e", "r", "s"]
    yield from ["", " ", "  ", "\n", "\n\n", " a", "a ", "▁", "▁a", "a▁b", "\n a", "日", " 日", "  日本 x", " " * 40, " " * 33 + "word"]
    for _ in range(1500):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
    letters = "etaoinshrdlu ETA.,'éü"
    for _ in range(800):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))
    yield "x" * 5000 + " " + "ab" * 3000


def test_equals_library(both):
    own, sp = both
    for t in texts():
        ids = sp.encode(t, add_bos=False, add_eos=True)
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == sp.decode(ids), repr(t)


def test_query_shape(lspark, make_docs, both):
    import hashlib
    _, sp = both
    cases = ["Ramiar con rata", None, "", "a  b\nc"]
    out = piece_bpe.encode_texts(make_docs(cases), PATH, digest=True).collect()
    for r, t in zip(sorted(out, key=lambda r: r["doc_id"]), cases):
        ids = sp.encode(t or "", add_eos=True)
        want = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), sp.decode(ids))]
        assert [r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]] == [len(ids), *want]
    full = piece_bpe.encode_texts(make_docs(cases), PATH).collect()
    assert [list(r["ids"]) for r in full] == [sp.encode(t or "", add_eos=True) for t in cases]


def test_empty(lspark, make_docs):
    assert piece_bpe.encode_texts(make_docs([]), PATH).collect() == []
