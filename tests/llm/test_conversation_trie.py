"""Conversation prefix trie against brute force, and its parentheses against a stack."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from shopmetrics.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    members = {}
    for c, p in whole.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    out = {}
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in m if whole[c] == p)
        out[(min(m), len(p))] = (
            min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in under),
            sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in under) for q in under),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def got(df):
    rows = ct.prefix_trie(df).collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
           for r in rows}
    assert len(out) == len(rows)
    return out


def test_findclose_equals_a_stack():
    rng = np.random.default_rng(3)
    for n in (1, 2, 31, 32, 33, 500, 5000):
        bits, left, depth = [], n, 0
        while left or depth:
            if left and (depth == 0 or rng.random() < 0.6):
                bits.append(1)
                left, depth = left - 1, depth + 1
            else:
                bits.append(0)
                depth -= 1
        want, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opened = np.array(sorted(want))
        assert ct.Parentheses(np.array(bits, np.uint8)).findclose(opened).tolist() == [want[i] for i in opened.tolist()]
    deep = np.array([1] * 3000 + [0] * 3000, np.uint8)
    assert ct.Parentheses(deep).findclose(np.arange(3000)).tolist() == list(range(5999, 2999, -1))


def conversations(rng, n):
    rows = []
    for c in rng.sample(range(4 * n), n):
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", rng.choice(["a", "é", "a long text", ""])))
    return rows


def test_equals_brute_force(lspark):
    rng = random.Random(11)
    rows = conversations(rng, 60)
    rows += [(1000 + k, t, "user", "same") for k in range(40) for t in range(3)]  # copies over several shards
    rows += [(2000 + k, t, "user", "same") for k in range(25) for t in range(2 + k)]  # each a start of the next
    rows += [(3000, t, "user", str(t)) for t in range(300)]
    rng.shuffle(rows)
    for partitions in ("1", "7", "40"):
        lspark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            assert got(lspark.createDataFrame(rows, SCHEMA)) == plain(rows)
        finally:
            lspark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nulls_ties_repeated_rows_turnless_and_long(lspark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (7, 2, None, "z"),
            (3, 0, "user", "only"), (10, 5, "user", "x" * 300000), (-4, 1, "user", "n"), (-4, None, "user", "n")]
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 9 > 0 and c % 5)
    rows.append((turnless, 0, "user", "gone"))
    rows = [r for r in rows if r[0] != -4]  # c % 5 of a negative id is the engine's, not Python's
    assert got(lspark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_and_clashing_columns(lspark):
    assert ct.prefix_trie(lspark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(k, t, "user", str(t)) for k in range(9) for t in range(4)]
    df = lspark.createDataFrame(rows, SCHEMA)
    for name in ("c", "pos", "key", "size", "path", "shard", "depth", "turn_", "h"):
        df = df.withColumn(name, F.lit("x"))
    assert got(df) == plain(rows)
