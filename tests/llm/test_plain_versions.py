"""Pseudonyms, toxicity and language ID against plain versions that work value by value: null, empty, very long and
repeated texts included."""

import datetime
import hashlib
import hmac
import math
import random
import re

import pytest

from shopmetrics.llm import langid, pseudonyms, toxicity

from .test_classifiers import corpus

MASK = (1 << 64) - 1


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# --- pseudonyms: values are words of the text

def plain_permute(key, kind, n, x):
    own = hmac.new(key, b"pseudonyms", hashlib.sha256).digest()
    bits = 1
    while 1 << 2 * bits < n:
        bits += 1

    def once(x):
        left, right = divmod(x, 1 << bits)
        for k in range(8):
            out = b""
            for i in range(-(-bits // 512)):
                out += hashlib.blake2b(f"{kind}|{n}|{k}|{right}".encode() + bytes([i]), key=own).digest()
            left, right = right, left ^ int.from_bytes(out[: -(-bits // 8)], "big") % (1 << bits)
        return right * (1 << bits) + left  # the halves change places at the end once more

    x = once(x)
    while x >= n:
        x = once(x)
    return x


def plain_luhn(digits):
    doubled = [sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


DAYS = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in range(73049)]
CLASSES = {"early date": [d for d in DAYS if d.day <= 12], "late date": [d for d in DAYS if d.day > 12]}


def plain_word(key, w):
    """The pseudonym of a word, or None."""
    if w.isdigit() and 13 <= len(w) <= 19 and plain_luhn(w) and len(set(w)) > 1:
        x = plain_permute(key, f"card{len(w)}{w[0]}", 10 ** (len(w) - 2), int(w[1:-1]))
        body = w[0] + str(x).rjust(len(w) - 2, "0")
        return next(body + c for c in "0123456789" if plain_luhn(body + c))
    if w.count(".") == 3 and all(p.isdigit() and len(p) <= 3 for p in w.split(".")):
        a, b, c, d = map(int, w.split("."))
        if not 1 <= a or max(a, b, c, d) > 255:
            return None
        least, count, kind = (1, 223, "ip") if a < 224 else (224, 32, "ip out of plan")
        x = plain_permute(key, kind, count * 256**3, (a - least) * 256**3 + b * 256**2 + c * 256 + d)
        return ".".join(str(v) for v in (x // 256**3 + least, x // 256**2 % 256, x // 256 % 256, x % 256))
    for form, fits in (("%Y-%m-%d", r"\d{4}-\d\d-\d\d"), ("%d/%m/%Y", r"\d\d/\d\d/\d{4}"), ("%m/%d/%Y", r"\d\d/\d\d/\d{4}")):
        if re.fullmatch(fits, w):
            try:
                day = datetime.datetime.strptime(w, form).date()
            except ValueError:
                continue
            kind = "late date" if day.day > 12 else "early date"
            days = CLASSES[kind]
            return days[plain_permute(key, kind, len(days), days.index(day))].strftime(form) if day in days else None
    if re.fullmatch(r"[a-z]+@[a-z]+\.com", w):
        local, domain = w.split("@")
        x = 0
        for c in local:
            x = 26 * x + ord(c) - 97
        x, out = plain_permute(key, "email" + "a" * len(local), 26 ** len(local), x), ""
        for _ in local:
            out, x = chr(97 + x % 26) + out, x // 26
        return f"{out}@{domain}"
    return None


def test_pseudonyms_equal_the_plain_version(lspark):
    rng, key = random.Random(4), b"plain"

    def word():
        pick = rng.randrange(9)
        if pick == 0:
            body = str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(rng.choice([11, 13, 14, 17])))
            return next(body + c for c in "0123456789" if plain_luhn(body + c)) if rng.random() < 0.8 else body + rng.choice("0123456789")
        if pick == 1:
            return ".".join(str(rng.choice([0, 1, 9, 77, 192, 223, 224, 255, 256])) for _ in range(4))
        if pick == 2:
            return rng.choice(DAYS).strftime(rng.choice(["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"]))
        if pick == 3:
            return rng.choice(["2023-02-30", "31/02/2020", "13/13/1999", "2100-01-01", "1899-12-31", "2000-02-29"])
        if pick == 4:
            return "".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 12))) + "@mail.com"
        return rng.choice(["plain", "words", "x9", "3.14", "é", "v1.2"])

    texts = [" and ".join(word() for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts += [None, "", texts[0], texts[0], " and ".join(word() for _ in range(20_000))]
    want = [None if t is None else " ".join(plain_word(key, w) or w for w in t.split(" ")) for t in texts]
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(frame(lspark, texts), key).collect()}
    assert [got[i]["new_text"] for i in range(len(texts))] == want
    for i, t in enumerate(texts):
        changed = 0 if t is None else sum(plain_word(key, w) is not None for w in t.split(" "))
        assert len(got[i]["pseudonyms"]) == changed
    assert sum(t != w for t, w in zip(texts, want)) > 300


def test_a_date_is_linked_in_every_order(lspark):
    f, rng = pseudonyms.Feistel(b"dates"), random.Random(6)
    for day in [datetime.date(2024, 1, 15), datetime.date(1991, 7, 15), *rng.choices(DAYS, k=1500)]:
        forms = ["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d/%m/%Y"] + ["%m/%d/%Y"] * (day.day > 12)
        new = [pseudonyms.replace(day.strftime(x), f)[0] for x in forms]
        assert len({datetime.datetime.strptime(n, x) for n, x in zip(new, forms)}) == 1, (day, new)
        assert [pseudonyms.replace(n, f, back=True)[0] for n in new] == [day.strftime(x) for x in forms]
    early = pseudonyms.replace("2024-01-12 2024-01-13", f)[0].split()
    assert int(early[0][-2:]) <= 12 < int(early[1][-2:])


# --- toxicity: noisy-or of the sentences

def plain_factor(place):
    x = (place + 1) * 0x9E3779B97F4A7C15 & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x | 1


def plain_toxicity(model, text):
    """The score and the number of sentences with a probability of a half or more."""
    clean, bad = 1.0, 0
    for sentence in re.split(rb"[\n\r!.;?]", (text or "").lower().encode()):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", sentence)
        if not words:
            continue
        s = model["bias"]
        for w in words:
            for size, mark in ((len(w), 0), (4, 4), (5, 5)):
                h = sum((c + 1) * plain_factor(k) for k, c in enumerate(w[:size])) & MASK
                s += float(model["w"][((h ^ mark) * 0x9E3779B97F4A7C15 & MASK) >> 46])
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
        clean *= 1 - p
        bad += p >= 0.5
    return 1 - clean, bad


def test_toxicity_equals_the_plain_noisy_or(lspark):
    rows = list(corpus(500, 8))
    texts = [t for *_, t in rows]
    texts += [None, "", "!?", texts[0], texts[0], "SCUM! the", " ".join(texts[:60]), "x" * 10_000 + " scum"]
    docs = frame(lspark, texts)
    labels = lspark.createDataFrame([(i, int(bad)) for i, _, bad, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, t in enumerate(texts):
        score, bad = plain_toxicity(model, t)
        assert got[i]["score"] == pytest.approx(score, abs=1e-5) and len(got[i]["offending"]) == bad, (i, t[:80])
    assert len({got[i]["score"] for i in (0, 503, 504)}) == 1 and got[505]["score"] > 0.3


# --- language ID: the nearest codeword

def plain_language(model, text):
    """The language, its share and whether the two best codewords are near."""
    code = [32 if c < 128 and not 97 <= c <= 122 else c for c in text.lower().encode()]
    counts = {}
    for k in range(4):
        for i in range(len(code) - k):
            gram = 0
            for c in code[i: i + k + 1]:
                gram = (gram * 0x01000193 + c + 1) % (1 << 32)
            place = ((gram ^ k * 0x9E3779B9 % (1 << 32)) * 0x85EBCA6B % (1 << 32)) >> 20
            counts[place] = counts.get(place, 0) + 1
    length = math.sqrt(sum(counts.values()))
    bits = range(model["code"].shape[1])
    margin = [float(model["w"][-1][b]) + sum(math.sqrt(n) / length * float(model["w"][p][b]) for p, n in counts.items()) for b in bits]
    loss = [sum(float(model["weight"][b]) * math.log1p(math.exp(-float(word[b]) * margin[b])) for b in bits) / float(sum(model["weight"]))
            for word in model["code"]]
    order = sorted(range(len(loss)), key=loss.__getitem__)
    share = 1 / sum(math.exp((loss[order[0]] - x) * len(bits)) for x in loss)
    return model["names"][order[0]], share, loss[order[1]] - loss[order[0]]


@pytest.mark.parametrize("languages", [2, 4])
def test_language_equals_the_plain_decoder(lspark, languages):
    rows = [(i, lang, t) for i, lang, _, t in corpus(240, 9) if languages == 4 or lang in ("en", "de")]
    first = rows[0][2]
    odd = [None, "", "12 ?!", "a", "É", "дом", first, first, " ".join(t for _, _, t in rows[:40]), "the und ion"]
    rows += [(1000 + k, None, t) for k, t in enumerate(odd)]
    docs = lspark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    for i, _, t in rows:
        r = got[i]
        if t is None or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0, True)
            continue
        lang, share, apart = plain_language(model, t)
        assert r["score"] == pytest.approx(share, abs=1e-3)
        if apart > 1e-4:
            assert r["lang_pred"] == lang
        if abs(apart - langid.MARGIN) > 1e-4:
            assert r["ambiguous"] == (apart < langid.MARGIN)
    assert got[rows[0][0]]["score"] == got[1006]["score"] == got[1007]["score"]
