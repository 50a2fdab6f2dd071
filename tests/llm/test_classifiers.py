"""Language ID and toxicity: held-out accuracy, and the edge cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from shopmetrics.llm import langid, toxicity

SYLLABLES = {"en": "the and ing tion er on", "de": "der und ung keit sch ein", "fr": "le et eau tion que ou", "es": "el y cion ado que os"}


def corpus(n, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.3
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["scum", "loweiund", "loweiei", "vequeau"]))
        yield i, lang, bad, ". ".join(" ".join(words[k:k + 9]) for k in range(0, len(words), 9))


def test_language_id_held_out(lspark):
    rows = list(corpus(500))
    extra = [(1000, None, "en"), (1001, "", "en"), (1002, "12 ?!", "de"), (1003, "THE AND ING", None), (None, "der und", "de")]
    docs = lspark.createDataFrame([(i, t, lang) for i, lang, _, t in rows] + extra, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    out = langid.identify(docs, model).withColumn("held_out", langid.held_out("doc_id", 5, 0)).collect()
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    held = [by[i]["lang_pred"] == lang for i, lang, _, _ in rows if by[i]["held_out"]]
    assert np.mean(held) > 0.97 and len(held) > 50
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "de"]
    assert by[1000]["score"] == 0 and all(0 <= r["score"] <= 1 for r in out)


def test_language_id_nothing_to_learn(lspark, make_docs):
    docs = make_docs(["the end", None], lang=None)
    assert langid.learn(docs) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    one = make_docs([(i, "some words") for i in range(9)] + [(50, None)])
    assert {r["lang_pred"] for r in langid.identify(one, langid.learn(one)).collect()} == {"en", "und"}
    assert langid.identify(make_docs([]), langid.learn(make_docs([]))).collect() == []


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 7, 40, 200):
        code = langid.codewords(k)
        apart = code.shape[1] - (code @ code.T + code.shape[1]) / 2 + 1000 * np.eye(k)
        assert apart.min() >= (1 if k < 7 else code.shape[1] / 4)


def test_toxicity_held_out_and_sentences(lspark):
    rows = list(corpus(900, 5))
    extra = [(2000, None), (2001, ""), (2002, "..."), (None, "the scum")]
    docs = lspark.createDataFrame([(i, t) for i, _, _, t in rows] + extra, "doc_id long, text string")
    labels = lspark.createDataFrame([(i, int(b)) for i, _, b, _ in rows] + [(2000, 0), (2001, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    by = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [((by[i]["score"] >= 0.3) == b) for i, _, b, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.95 and len(held) > 100
    assert by[2000]["score"] == by[2001]["score"] == by[2002]["score"] == 0 and by[None]["score"] > 0.3
    bad = [r["offending"] for i, _, b, _ in rows if b and (r := by[i])["score"] > 0.5]
    assert np.mean([any(w in s for w in ("scum", "lowei", "vequ") for s in x) for x in bad]) > 0.95
    assert np.mean([len(x) == 1 for x in bad]) > 0.8


def test_toxicity_nothing_to_learn(lspark, make_docs):
    docs = make_docs(["a b", None])
    labels = lspark.createDataFrame([(0, 1)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.score(make_docs([]), None).collect() == []


def test_all_of_300_languages_are_learned(lspark, make_docs):
    rng = random.Random(2)
    letters = "bcdfghjklmnpqrstvwz"
    names = [a + v + b for a in letters for v in "aeiou" for b in letters][:: 6][:300]
    rows = [(k * 300 + i, " ".join(name * rng.randint(1, 2) for _ in range(30)), f"l{i:03}") for i, name in enumerate(names) for k in range(6)]
    docs = lspark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model["names"]) == 300
    out = langid.identify(docs, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95


def test_own_columns_with_the_names_of_the_result(lspark, make_docs):
    docs = lspark.createDataFrame([(i, t, lang) for i, lang, _, t in corpus(60)], "doc_id long, text string, lang string")
    docs = docs.withColumn("score", F.lit("own")).withColumn("lang_pred", F.lit("own"))
    r = langid.identify(docs, langid.learn(docs)).first()
    assert (r["score"], r["lang_pred"]) == ("own", "own") and 0 <= r["score_"] <= 1 and r["lang_pred_"] in SYLLABLES
    labels = lspark.createDataFrame([(i, int(bad)) for i, _, bad, _ in corpus(60)], "doc_id long, toxic int")
    r = toxicity.score(docs, toxicity.learn(docs, labels)).first()
    assert r["score"] == "own" and 0 <= r["score_"] <= 1
