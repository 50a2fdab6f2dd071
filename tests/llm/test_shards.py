"""Sharding: the laws of the contract, and one-level scheduling as the measure of evenness."""

import random
import zlib
from collections import Counter, defaultdict

from shopmetrics.llm import shards


def laws(rows, texts, n):
    by_text, load, slots = defaultdict(set), Counter({s: 0 for s in range(n)}), defaultdict(list)
    for r in rows:
        t = texts[r["id"]]
        size = (0 if t is None else len(t.encode())) + 1
        assert r["size"] == size and r["text_crc32"] == zlib.crc32((t or "").encode()) and 0 <= r["shard"] < n
        by_text[t].add(r["shard"])
        load[r["shard"]] += size
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_even_and_together(lspark, make_docs):
    rng = random.Random(4)
    texts = [None, "", None, "ééé"] + ["w" * rng.randint(1, 900) for _ in range(700)] + ["copy"] * 200
    rng.shuffle(texts)
    rows = shards.assign(make_docs(texts)).collect()
    assert len(rows) == len(texts)
    load = laws(rows, texts, 8)
    groups = Counter()
    for t in texts:
        groups[t] += (0 if t is None else len(t.encode())) + 1
    best = Counter()
    for size, s in zip(groups.values(), shards.least_loaded([(x, i) for i, x in enumerate(groups.values())], 8)):
        best[s] += size
    assert max(load.values()) - min(load.values()) <= max(20, 2 * (max(best.values()) - min(best.values())))


def test_one_group_larger_than_a_share_and_repeated_rows(lspark, make_docs):
    texts = ["x" * 10_000] * 3 + ["y", "z", "q"]
    load = laws(shards.assign(make_docs(texts), shards=3).collect(), texts, 3)
    assert sorted(load.values()) == [2, 4, 30_003]
    rows = shards.assign(make_docs([(1, "a"), (1, "a"), (None, "b"), (None, None)]), shards=2).collect()
    assert len(rows) == 4 and all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in (0, 1))


def test_rows_without_an_id_are_numbered_in_many_pieces(lspark, make_docs):
    texts = ["w" * n for n in range(1500)]
    rows = shards.assign(make_docs([(None, t) for t in texts])).collect()
    assert sorted(r["size"] for r in rows) == list(range(1, 1501))
    for s in range(8):
        own = sorted((r["slot"], r["size"]) for r in rows if r["shard"] == s)
        assert [slot for slot, _ in own] == list(range(len(own)))
        # Numbered in one piece, they would stand by size.
        assert sum(b < a for (_, a), (_, b) in zip(own, own[1:])) > 5


def test_empty(lspark, make_docs):
    assert shards.assign(make_docs([])).collect() == []
