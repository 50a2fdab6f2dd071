"""Decontamination against a brute-force version."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from shopmetrics.llm import decontaminate as dec

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(text, items, n):
    w = words_of(text)
    hit, names, longest = set(), set(), 0
    for name, item in items:
        v = words_of(item)
        size = min(n, len(v))
        for i in range(len(v) - size + 1 if v else 0):
            for p in range(len(w) - size + 1):
                if w[p:p + size] == v[i:i + size]:
                    hit |= set(range(p, p + size))
                    names |= {str(name)} if name is not None else set()
                    m = size
                    while p + m < len(w) and i + m < len(v) and w[p + m] == v[i + m]:
                        m += 1
                    longest = max(longest, m)
    return len(w), len(hit), sorted(names), longest or None


def make(rng):
    vocab = ["the", "Été", "ÉTÉ", "and", "x1", "7", "naïve", "İx", "zzz", "long" * 30, "日本", "a_b"]
    def say(k): return [rng.choice(vocab) for _ in range(k)]
    items = [(i, " ".join(say(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(12)]
    items += [(20, items[3][1]), (21, None), (22, ""), (23, "... !!"), (None, " ".join(say(15)))]
    texts = [None, "", "!?", " ".join(say(400))]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 5)
            parts.append(" ".join(say(rng.randint(0, 40)) + v[a:a + rng.randint(1, 40)]))
        texts.append(rng.choice([" ", "\n", "--"]).join(parts).upper() if rng.random() < 0.2 else ", ".join(parts))
    return texts, items


def test_equals_brute_force(lspark, make_docs):
    texts, items = make(random.Random(11))
    items = [x for x in items if x[1] is None or len(words_of(x[1])) != 1]
    bench = lspark.createDataFrame(items, "item_id long, text string")
    for n, block in ((13, dec.BLOCK_BYTES), (4, 300)):
        out = dec.find_matches(make_docs(texts), bench, n=n, block_bytes=block)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), r["longest_match"]) for r in out.collect()}
        assert got == {i: plain(t, items, n) for i, t in enumerate(texts)}


def test_one_word_item_and_extra_columns(lspark, make_docs):
    docs = make_docs(["zebra " + "x " * 30, "zebra y", "clean text", None]).withColumn("match_n_hit", F.lit("q"))
    bench = lspark.createDataFrame([("a", "Zebra!")], "item_id string, text string")
    kept = dec.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_empty_tables(lspark, make_docs):
    bench = lspark.createDataFrame([], "item_id long, text string")
    assert dec.decontaminate(make_docs(["a b", None]), bench).count() == 2
    assert dec.find_matches(make_docs([]), bench).collect() == []


def test_words_over_shard_borders_and_hash_places():
    import numpy as np
    data = np.frombuffer("abcdef".encode(), np.uint8)
    assert len(dec.words_of(data, np.array([0, 3, 3, 6]), dec.multipliers())[3]) == 2


def test_one_run_of_periodic_text(lspark, make_docs):
    """Shards with one run of item words, where suffixes tie up to the end of the text."""
    for words in (["a"] * 13, ["a"] * 30, ["a", "b"] * 7, ["a", "b"] * 13, ["a", "b", "a"] * 9):
        text = " ".join(words)
        bench = lspark.createDataFrame([("x", text)], "item_id string, text string")
        got = dec.find_matches(make_docs([text]), bench).first()
        assert (got["n_words"], got["n_hit"], list(got["items"]), got["longest_match"]) == plain(text, [("x", text)], 13), text


def test_suffix_array_is_in_order():
    import numpy as np
    for ids in ([1] * 13, [1, 2] * 7, [2, 1] * 13, [1, 1, 2] * 9, [3, 0, 3, 3], [1, 0, 1, 1, 0, 1]):
        assert dec.suffix_array(np.array(ids), 13).tolist() == sorted((k for k in range(len(ids)) if ids[k]), key=lambda k: ids[k: k + 16])


def test_long_words_that_differ_beyond_place_4096(lspark, make_docs):
    one, two = "a" + 4095 * "x" + "b", "b" + 4095 * "x" + "a"
    bench = lspark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    docs = make_docs([one, two, "a" + 4095 * "x" + "c", f"{two} {one}"])
    out = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in dec.find_matches(docs, bench).collect()}
    assert out == {0: (1, 1, ["1"]), 1: (1, 1, ["2"]), 2: (1, 0, []), 3: (2, 2, ["1", "2"])}


def test_words_of_one_hash_are_told_apart():
    block = dec.TestBlock([(["1"], "aa bb cc")], 13)
    block.hashes = np.full(3, block.hashes[0], np.uint64)  # as if all three words had one hash
    block.known[:] = True
    low, at = np.frombuffer(b"cc bb aa cc", np.uint8), np.array([0, 11])
    low, start, end, h = dec.words_of(low, at, dec.multipliers())
    h[:] = block.hashes[0]
    place, _ = block.search(low, start, end, np.zeros(len(start), np.int64), h)
    assert place.tolist() == []
    low, at = np.frombuffer(b"cc aa bb cc", np.uint8), np.array([0, 11])
    low, start, end, h = dec.words_of(low, at, dec.multipliers())
    h[:] = block.hashes[0]
    assert block.search(low, start, end, np.zeros(len(start), np.int64), h)[0].tolist() == [1]


def test_own_columns_with_the_names_of_the_result(lspark, make_docs):
    bench = lspark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = make_docs(["a b c"]).withColumn("n_hit", F.lit("own")).withColumn("N_WORDS", F.lit("own"))
    r = dec.find_matches(docs, bench).first()
    assert (r["n_hit"], r["N_WORDS"], r["n_hit_"], r["n_words_"]) == ("own", "own", 2, 3)
