"""SimHash near-dedup against a brute-force version."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from shopmetrics.llm import simhash


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """rows: (id, fp); the smallest id reachable over links of 3 bits or fewer."""
    of = {fp: min(i for i, f in rows if f == fp) for fp in {f for _, f in rows}}
    fps, comp, changed = list(of), dict(of), True
    near = {a: [b for b in fps if (a ^ b).bit_count() <= 3] for a in fps}
    while changed:
        changed = False
        for a in fps:
            low = min(comp[b] for b in near[a])
            if low < comp[a]:
                comp[a], changed = low, True
    return comp


def words(rng, n):
    return [rng.choice(["alpha", "Beta", "gámma", "delta", "eps", "zeta", "eta", "theta", "iota"]) + str(rng.randint(0, 99)) for _ in range(n)]


def test_equals_brute_force(lspark, make_docs):
    rng = random.Random(3)
    texts = ["", None, "one", "two words", "ONE", " \t\x0b", "a\x1cb\x85c d"]
    for n in (40, 200, 400, 3000):
        base = words(rng, n)
        texts.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            near[rng.randrange(n)] = "other"
            texts.append("\n".join(near) if rng.random() < 0.5 else "  ".join(near))
        texts += [texts[-1]] * 2
    got = {r["id"]: (r["fp"] % 2**64, r["component"]) for r in simhash.near_duplicates(make_docs(texts)).collect()}
    want = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    comp = plain_components(want)
    assert got == {i: (f, comp[f]) for i, f in want}
    assert len({c for _, c in got.values()}) < len(texts) - 6


def test_links_connect_planted_distances(lspark):
    rng = random.Random(5)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        for d in (0, 1, 2, 3, 4, 5):
            x = base
            for b in rng.sample(range(64), d):
                x ^= 1 << b
            fps.append(x)
    rows = [(i, f) for i, f in enumerate(fps)]
    df = lspark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(set(fps))], "fp long")
    for tile in (2048, 3):
        star = simhash.connected_components(simhash.links(simhash.replicas(df), tile=tile))
        root = {r["node"] % 2**64: r["root"] for r in star.collect()}
        groups = {}
        for f in set(fps):
            groups.setdefault(root.get(f, int(np.uint64(f).view(np.int64))), set()).add(f)
        want = {}
        for f, c in plain_components(rows).items():
            want.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_dense_anchor_in_tiles(lspark):
    """Many different fingerprints within two bits of one: one component, also when dealt over tiles."""
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a, 64)})
    df = lspark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    star = simhash.connected_components(simhash.links(simhash.replicas(df), tile=50)).collect()
    assert len(star) == len(fps) - 1 and len({r["root"] for r in star}) == 1


def test_keep_one_and_clashing_columns(lspark, make_docs):
    docs = make_docs([(5, "x y z a b c"), (3, "x y z a b c"), (3, "x y z a b c"), (9, "q w e r t y"), (None, "q w e r t y")])
    docs = docs.withColumn("kept_id", F.lit(1)).withColumn("fp", F.lit("s")).withColumn("salt", F.lit(0))
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [3, 9, None]


def test_keep_one_of_one_id_with_unlike_texts(lspark, make_docs):
    a, b = "x y z a b c", "q w e r t y u i o p"
    docs = make_docs([(3, a), (3, b), (7, b)])
    assert sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()) == sorted([(3, a), (3, b)])
    docs = make_docs([(1, a), (3, a), (3, b), (3, b), (None, a)])
    assert sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()), key=str) == sorted([(1, a), (3, b), (None, a)], key=str)


def test_empty(lspark, make_docs):
    assert simhash.near_duplicates(make_docs([])).collect() == []
    assert simhash.keep_one(make_docs([])).collect() == []
