"""The quality model reads every byte: texts that differ inside a class of bytes only are told apart."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmetrics.llm import quality as q

from . import test_quality as plain


def byte_symbols(text):
    """1 to 256 for bytes 0 to 255."""
    return [1 + b for b in re.sub(r"[\x20\x09-\x0D]+", " ", text or "").lstrip(" ").encode()]


class ByteModel(plain.PlainModel):
    def p(self, gram):
        return super().p(gram) if gram else 1 / 251


def test_bytes_are_told_apart():
    codes = [int(x) for x in q.BYTES.code]
    blanks = [9, 10, 11, 12, 13, 32]
    assert {codes[b] for b in blanks} == {q.BYTES.space}
    others = [codes[b] for b in range(256) if b not in blanks]
    assert len(set(others)) == 250 and not {0, q.BYTES.space} & set(others) and q.BYTES.size == 251
    # Bytes with the highest bit fill all 32 bits of an n-gram.
    key, _ = q.grams(np.array([0xFF, 0xFE, 0xFD, 0xFC], np.uint8), np.array([0, 4]), q.BYTES)
    assert key.tolist() == [0xFF, 0xFFFE, 0xFFFEFD, 0xFFFEFDFC]


def test_measure_of_bytes_equals_the_plain_model(lspark, make_docs, monkeypatch):
    monkeypatch.setattr(plain, "symbols", byte_symbols)
    rng = random.Random(8)
    texts = [*plain.TEXTS, "a\x00b \x00\x00", "АБВ абв где", "ÀÉ àé 12 34"] + [plain.prose(rng, rng.randint(0, 80), "abAB12éд") for _ in range(80)]
    rows = q.measure(make_docs(texts).repartition(3), alphabet=q.BYTES).withColumn("of", F.pmod(F.xxhash64("text"), F.lit(2))).collect()
    models = [ByteModel([r["text"] for r in rows if r["of"] == k]) for k in (0, 1)]
    for r in rows:
        want = models[1 - r["of"]].log_perplexity(r["text"])
        assert r["n_symbols_read"] == len(byte_symbols(r["text"]))
        assert r["log_perplexity"] == (want if want is None else pytest.approx(want, rel=1e-9))


@pytest.mark.parametrize("other", [str.upper, lambda t: t.translate(str.maketrans("абвгдежзий", "РСТУФХЦЧШЩ"))])
def test_a_class_of_bytes_hides_nothing(lspark, make_docs, other):
    """The same text in other bytes of the same classes was given the perplexity of the clean texts and was kept."""
    rng = random.Random(5)
    letters = "abcdefghij" if other is str.upper else "абвгдежзий"
    clean = [plain.prose(rng, 200, letters) for _ in range(200)]
    odd = other(plain.prose(rng, 200, letters))
    rows = {r["id"]: r for r in q.judge(make_docs([*enumerate(clean), (900, odd)])).collect()}
    assert sum(rows[i]["kept"] for i in range(200)) >= 198
    assert not rows[900]["kept"] and rows[900]["perplexity"] > 2 * rows[0]["perplexity"]
