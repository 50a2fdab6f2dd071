"""Embedding near-dedup: links and components against brute force, recall on random directions."""

import numpy as np
import pytest

from shopmetrics.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, cosine=0.98):
    def ok(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows if ok(v, label)]
    near = {i: set() for i, *_ in rows}
    for a, (i, x, p) in enumerate(good):
        for j, y, q in good[:a]:
            if p == q and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine:
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen))
    return out


def got(df, **options):
    return {r["id"]: (r["n_links"], r["component"]) for r in embed_dedup.near_duplicates(df, **options).collect()}


def near(rng, base, cosine):
    d = rng.normal(size=len(base))
    d -= d @ base * base / (base @ base)
    return cosine * base / np.linalg.norm(base) + np.sqrt(1 - cosine**2) * d / np.linalg.norm(d)


def test_equals_brute_force(lspark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(25):
        base = rng.normal(size=32)
        rows += [(near(rng, base, c) * rng.uniform(0.1, 9), int(rng.integers(2))) for c in (1, 0.999, 0.995, 0.995, 0.99, 0.97)]
    rows += [(rows[0][0], rows[0][1])] * 7 + [(rng.normal(size=16), 1), (np.zeros(32), 1), (rows[0][0], None)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    rows += [(900, None, 1), (901, [], 0), (902, [float("nan")] * 32, 1), (903, [None] + [1.0] * 31, 0), (904, [float("inf")] + [1.0] * 31, 0)]
    df = lspark.createDataFrame(rows, SCHEMA)
    want, found = plain(rows), got(df)
    assert set(want) == set(found)
    missed = sum(want[i] != found[i] for i in want)
    assert missed <= 0.02 * len(want)
    assert all(found[i] == (0, i) for i in range(900, 905))
    assert all(found[i][0] <= want[i][0] for i in want)


def test_hot_bucket_in_tiles(lspark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=24)
    rows = [(i, near(rng, base, 0.9975 if i % 2 else 0.995).tolist(), 1) for i in range(150)]
    rows += [(200 + i, rows[0][1], 1) for i in range(5)]
    df = lspark.createDataFrame([(i, [float(np.float32(x)) for x in v], k) for i, v, k in rows], SCHEMA)
    want = plain([tuple(r) for r in df.collect()])
    full = embed_dedup.links.__defaults__
    try:
        embed_dedup.links.__defaults__ = (0.98, 20)
        found = got(df)
    finally:
        embed_dedup.links.__defaults__ = full
    assert np.mean([found[i] == want[i] for i in want]) > 0.95


@pytest.mark.parametrize("d", [2, 3, 4, 8, 12, 16, 24, 32, 64, 200])
def test_recall_on_random_and_clustered_directions(d):
    """Of random pairs at cosine 0.98 exactly, the hardest that must link, 95 of 100 meet in a table, whatever the length."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, d))
    for x in (rng.normal(size=(3000, d)), centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, d))):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        y = np.array([near(rng, v, 0.98) for v in x])
        model = embed_dedup.learn(x)
        a, b = (embed_dedup.table_keys(embed_dedup.codes(v, model), d) for v in (x, y))
        assert (a == b).any(1).mean() > 0.95


def test_empty_and_nothing_usable(lspark):
    assert got(lspark.createDataFrame([], SCHEMA)) == {}
    assert got(lspark.createDataFrame([(1, None, 1), (2, [0.0], 1)], SCHEMA)) == {1: (0, 1), 2: (0, 2)}


def test_every_length_has_its_own_rotation(lspark):
    """Long vectors whose first components, as many as the most frequent length has, tell nothing."""
    rng = np.random.default_rng(8)
    rows = [rng.normal(size=16) for _ in range(150)]
    for _ in range(30):
        base = rng.normal(size=48)
        rows += [np.concatenate([0.01 * rng.normal(size=16), near(rng, base, 0.999)]) for _ in range(2)]
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(rows)]
    want, found = plain(rows), got(lspark.createDataFrame(rows, SCHEMA))
    assert sum(n for n, _ in want.values()) >= 40
    assert sum(want[i] != found[i] for i in want) <= 0.02 * len(want)
