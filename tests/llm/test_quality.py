"""Quality rules: the figures and the model against brute force, and verdicts on planted texts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmetrics.llm import quality as q

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_figures(text):
    text = text or ""
    words = _WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))


def symbols(text):
    return [q.class_of(b) for b in re.sub(r"[\x20\x09-\x0D]+", " ", text or "").lstrip(" ").encode()]


class PlainModel:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts):
        top = Counter()
        for t in texts:
            s = [0, 0, 0, *symbols(t)]
            top.update(tuple(s[i - 3:i + 1]) for i in range(3, len(s)))
        self.levels = [top]
        for _ in range(3):
            self.levels.insert(0, Counter(g[1:] for g in self.levels[0]))
        self.d = []
        for level in self.levels:
            n = [sum(c == k for c in level.values()) for k in range(1, 5)]
            if all(n):
                y = n[0] / (n[0] + 2 * n[1])
                d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
                self.d.append([0, *(min(max(x, 0.01), m) for x, m in zip(d, (0.99, 1.99, 2.99)))])
            else:
                self.d.append([0, 0.5, 1.0, 1.5])
        self.contexts = []
        for level, d in zip(self.levels, self.d):
            at = {}
            for g, c in level.items():
                x = at.setdefault(g[:-1], [0, 0.0])
                x[0] += c
                x[1] += d[min(c, 3)]
            self.contexts.append(at)

    def p(self, gram):
        if not gram:
            return 1 / 61
        level, d, at = (x[len(gram) - 1] for x in (self.levels, self.d, self.contexts))
        if gram[:-1] not in at:
            return self.p(gram[1:])
        total, off = at[gram[:-1]]
        c = level.get(gram, 0)
        return max(c - d[min(c, 3)], 0) / total + off / total * self.p(gram[1:])

    def log_perplexity(self, text):
        s = [0, 0, 0, *symbols(text)]
        return -sum(math.log(self.p(tuple(s[i - 3:i + 1]))) for i in range(3, len(s))) / (len(s) - 3) if len(s) > 3 else None


def prose(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, weights=range(1, len(letters) + 1), k=rng.randint(1, 7))) + rng.choice(["", "", ",", "."]) for _ in range(n))


TEXTS = [None, "", " \n\t", "one", "a b c d e f g h", "x y z w v u t s " * 3, "é è ü \x0b\x1c\x85 ok", "# $5 * 3% <b> &|", "l1\nl1\n\n\n l1\nl2\r\nl2\r\n\n",
         "日本語 の テキスト", "w" * 70000 + " " + "w" * 70000, "1 2 3 4 5 6 7 8\n1 2  3 4 5 6 7 8 9", "same\n" * 500]


def test_figures_equal_brute_force():
    rng = random.Random(4)
    texts = TEXTS + [prose(rng, rng.randint(0, 60), "abc").replace(",", "\n") for _ in range(100)] + [" ".join(rng.choices("ab", k=400))]
    raw = [(t or "").encode() for t in texts]
    out = q.figures(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    for k, t in enumerate(texts):
        assert tuple(out[:, k].tolist()) == plain_figures(t), t


def test_measure_equals_the_plain_model(lspark, make_docs):
    rng = random.Random(7)
    texts = TEXTS + [prose(rng, rng.randint(0, 80)) for _ in range(80)]
    docs = make_docs(texts).withColumn("half", F.lit("x")).repartition(3)
    rows = q.measure(docs).withColumn("of", F.pmod(F.xxhash64("text"), F.lit(2))).collect()
    halves = [[r["text"] for r in rows if r["of"] == k] for k in (0, 1)]
    models = [PlainModel(x) for x in halves]
    assert min(len(set(x)) for x in halves) > 20
    for r in rows:
        assert tuple(r[k] for k in q.FIGURES) == plain_figures(r["text"])
        want = models[1 - r["of"]].log_perplexity(r["text"])
        assert r["n_symbols_read"] == len(symbols(r["text"]))
        assert r["log_perplexity"] == (want if want is None else pytest.approx(want, rel=1e-9))


def test_probabilities_add_up_to_one():
    rng = random.Random(1)
    raw = [prose(rng, 300).encode() for _ in range(20)]
    key, _ = q.grams(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    model = q.Model(*np.unique(key, return_counts=True))
    for context in [*np.unique(key >> np.uint32(6))[:50].tolist(), 0xFFFFF, 0]:
        p = np.exp(model.log_probability((context << 6) + np.arange(1, 62)))
        assert p.sum() == pytest.approx(1, abs=1e-9) and (p > 0).all()


def test_verdicts(lspark, make_docs):
    rng = random.Random(9)
    clean = [prose(rng, 200) for _ in range(300)]
    noise = ["".join(rng.choices("qwxyz#;!?0 ", k=1500)) for _ in range(4)]  # letters the rest hardly has
    boiler = [" ".join(["jjj jjjj jj jjjjj"] * 2 + ["j" * rng.randint(1, 9) for _ in range(150)])]
    rows = [(i, t) for i, t in enumerate(clean + noise + boiler + ["too short", None, clean[0], "again and again and again and again " * 20])]
    rows += [(0, clean[0]), (None, clean[1])]
    out = q.judge(make_docs(rows)).collect()
    assert len(out) == len(rows)
    verdict = {r["id"]: (r["base_failed"], r["kept"]) for r in out}
    assert sum(verdict[i] == (False, True) for i in range(300)) >= 298
    assert [verdict[i] for i in range(300, 305)] == [(False, False)] * 5
    assert [verdict[i] for i in (305, 306, 307, 308)] == [(True, False), (True, False), verdict[0], (True, False)]
    assert verdict[None] == verdict[1]


def test_languages_have_bands_of_their_own(lspark, make_docs):
    rng = random.Random(3)
    a, b = make_docs([(i, prose(rng, 150)) for i in range(150)], lang="aa"), make_docs([(200 + i, prose(rng, 150, "klmnopqrst" * 2 + "uvwxyz")) for i in range(50)], lang=None)
    strange = make_docs([(900, prose(rng, 300, "klmnopqrst" * 2 + "uvwxyz"))], lang="aa")
    verdict = {r["id"]: r["kept"] for r in q.judge(a.union(b).union(strange)).collect()}
    assert not verdict[900] and sum(verdict[i] for i in range(150)) >= 148 and sum(verdict[200 + i] for i in range(50)) >= 48


def test_empty(lspark, make_docs):
    assert q.judge(make_docs([])).collect() == []
    assert [r["kept"] for r in q.judge(make_docs([None, ""])).collect()] == [False, False]
