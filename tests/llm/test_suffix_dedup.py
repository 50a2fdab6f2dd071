"""Suffix-array dedup against a brute-force version, and the merge against sorting."""

import random

import numpy as np

from shopmetrics.llm import suffix_dedup as sd


def plain(rows):
    """rows: (id, text) in order.  What remains of each, as (bytes, removed, spans, kept)."""
    seen, out = set(), []
    for _, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p:p + 100]
            if w in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((len(raw), sum(gone), spans, bytes(c for k, c in enumerate(raw) if not gone[k])))
    return out


def say(rng, n):
    return "".join(rng.choice("abcdefgh é") for _ in range(n))


def check(lspark, make_docs, rows, **options):
    out = sd.remove_repeats(make_docs(rows), **options).collect()
    got = sorted((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out)
    want = sorted((i, *x) for (i, _), x in zip(sorted(rows), plain(sorted(rows))))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w, (g[:4], w[:4])


def test_equals_brute_force(lspark, make_docs):
    rng = random.Random(6)
    pool = [say(rng, rng.choice([99, 100, 101, 130, 180, 400])) for _ in range(14)]
    texts = [None, "", "short", "é" * 50, "a" * 99, "a" * 100, "a" * 101, "a" * 700, "ab" * 300, "abc" * 200, "x" + "ab" * 160, pool[0] * 3]
    for _ in range(70):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.choice([0, 0, rng.randrange(len(p))])
            parts.append(say(rng, rng.choice([0, 1, 30, 200])) + p[a: rng.choice([len(p), rng.randint(a, len(p))])])
        texts.append("".join(parts))
    texts += [texts[-1]] * 4 + [texts[-2][:-1] + "Z"]
    ids = rng.sample(range(-50, 900), len(texts))
    check(lspark, make_docs, [(i, t or "") for i, t in zip(ids, texts)])


def test_many_contexts_of_one_passage(lspark, make_docs):
    """A group of many different suffixes takes the array way."""
    rng = random.Random(7)
    passage = say(rng, 110)
    rows = [(k, say(rng, rng.randint(40, 80)) + passage[: rng.choice([110, 110, 104, 90])] + say(rng, rng.randint(40, 80))) for k in range(60)]
    check(lspark, make_docs, rows)


def test_repeated_ids_null_ids_and_slices(lspark, make_docs, monkeypatch):
    rng = random.Random(8)
    t = say(rng, 300)
    out = sd.remove_repeats(make_docs([(4, t), (4, t), (None, t), (9, "q" + t)])).collect()
    got = sorted((str(r["id"]), r["n_removed"]) for r in out)
    n = len(t.encode())
    assert got == [("4", n), ("4", n), ("9", n), ("None", 0)]
    data = np.frombuffer((say(rng, 3000) + "a" * 500).encode(), np.uint8)
    whole = sd.suffixes(data, np.array([1000, 1000, len(data)]), sd.byte_codes())
    monkeypatch.setattr(sd, "SLICE", 137)
    cut = sd.suffixes(data, np.array([1000, 1000, len(data)]), sd.byte_codes())
    def windows(x): return {(p, s, h) for s, a, b, h in zip(*x) for p in range(a, b + 1)}
    assert windows(whole) == windows(cut)
    assert {p for p, *_ in windows(whole)} == set(range(901)) | set(range(1000, len(data) - 99))


def test_empty(lspark, make_docs):
    assert sd.remove_repeats(make_docs([]), digest=True).collect() == []


def test_merge_equals_sorting():
    rng = random.Random(9)
    def word(): return bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9)))
    for n in (0, 1, 2, 3, 7, 20):
        runs = [sorted((word(), word(), rng.randrange(9), rng.randrange(10**6)) for _ in range(rng.randint(0, 30))) for _ in range(n)]
        packed = [sd.pack_run(r, [0] + [sd.common(a[0], b[0]) for a, b in zip(r, r[1:])]) for r in runs]
        assert all([e[:4] for e in sd.read_run(p)] == r for p, r in zip(packed, runs))
        got = list(sd.merge([sd.read_run(p) for p in packed]))
        want = sorted(e for r in runs for e in r)
        assert [e[:4] for e, _, _ in got] == want
        assert [k for _, k, _ in got][1:] == [sd.common(a[0], b[0]) for a, b in zip(want, want[1:])]
        assert all(e[:4] in runs[r] for e, _, r in got)


def crowded(rng, n):
    """Texts that share passages, each time in other surroundings."""
    passages = [say(rng, k) for k in (66, 80, 110, 320)]
    def around(): return say(rng, rng.randint(40, 80))
    texts = [around() + passages[k % 4] + around() + passages[rng.randrange(4)] + around() for k in range(n)]
    return [*texts, texts[0], texts[1], passages[3] * 2, passages[2] + around()]


def test_windows_of_crowded_starts_are_dealt_out(lspark, make_docs):
    rng = random.Random(12)
    rows = [(k - 20, t) for k, t in enumerate(crowded(rng, 70))]
    for big in (0, 5, 60):
        check(lspark, make_docs, rows, big=big)
    texts = [t for _, t in rows]
    check(lspark, make_docs, [(k, t) for k, t in enumerate(["a" * 300, "ab" * 200, "é" * 90, *texts[:20], *texts[:20]])], big=3, bucket_bytes=3000)


def test_crowded_starts_leave_the_merge(lspark, make_docs):
    """No range gets more than ``big`` suffixes of one start, however many documents share it."""
    rows = [(k, t) for k, t in enumerate(crowded(random.Random(13), 120))]
    docs = make_docs(rows).selectExpr("0 bucket", "text")
    many = [np.frombuffer(r["many"], np.uint64) for r in sd.repeated_hashes(docs, 1, 0.0, 40).collect() if r["bucket"] >= 0]
    raw = [t.encode() for _, t in rows]
    h = sd.suffixes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(t) for t in raw]), sd.byte_codes())[3]
    kinds, times = np.unique(h, return_counts=True)
    assert times.max() > 40 and sorted(np.concatenate(many)) == sorted(kinds[times > 40])
