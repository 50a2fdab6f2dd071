"""The prefix trie of conversations, as balanced parentheses shard by shard.

A turn (role, text) is a digest of 128 bits, a conversation the path of its digests.  Paths are sorted over all
conversations and dealt to shards by ranges of (path, conv_id), so that copies and conversations that share a long start are
split over shards like any others.  A shard writes its trie as balanced parentheses: what a path shares with the path
before it stays open, the rest is closed, its own turns are opened.  On these bits

* ``findclose`` delimits the subtree of a node: blocks of the excess with their minima in a range min-max tree, searched
  for all nodes in lockstep;
* the rank of leaf pairs ``()`` between both parentheses counts the leaves;
* cumulative arrays in the order of the nodes give conversations and savings of a subtree by two look-ups.

Shared spines.  A node whose conversations lie in several shards is on the last path of one shard and on the first path of
the next.  Every shard is given the last path before it and the first path after it, so it knows which of its nodes
are shared.  The last shard that holds a node owns it: only there does the node count as a leaf, as a child and with
the bytes that one copy of its text takes; everything else adds up.  The shared nodes alone (at most two paths a
shard) are then merged by the digest of their path, and the few rows below them get their parent's merged id.

Contract of a node: (conv_id, depth), conv_id its smallest member, names it.

Bounds: a task holds one shard, which is 1/n of all turns at 24 bytes each, n the session's shuffle partitions; a
conversation's digests lie in one row.  The texts themselves are hashed at once.  The driver holds the numbers of the shards.

Cases: a null role or text is empty; rows with a null conv_id belong to no conversation and are left out; rows of one
conversation with equal turn follow each other by role and text, and repeated rows are turns of their own; a null turn comes
first; a conversation may be turnless and is then a member of the root alone; an empty table has no root and no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.llm.common import materialize, salted_join

#: Bytes of a turn's digest, and bits in a block of the range min-max tree.
DIGEST, BLOCK = 16, 64
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with block minima of the excess in a tree."""

    def __init__(self, bits: np.ndarray):
        self.excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = max(1, -(-len(bits) // BLOCK))
        self.size = 1 << (blocks - 1).bit_length()
        padded = np.full(self.size * BLOCK, np.iinfo(np.int64).max)
        padded[: len(bits)] = self.excess
        self.rows = padded.reshape(self.size, BLOCK)
        self.low = np.zeros(2 * self.size, np.int64)  # a heap: the minimum of node k is that of 2k and 2k + 1
        self.low[self.size:] = self.rows.min(1)
        for k in range(self.size.bit_length() - 2, -1, -1):
            a = 1 << k
            self.low[a: 2 * a] = self.low[2 * a: 4 * a].reshape(-1, 2).min(1)

    def in_block(self, block: np.ndarray, target: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The first place of a block beyond ``after`` with excess ``target`` or less; -1 if there is none."""
        out = np.full(len(block), -1)
        for i in range(0, len(block), 1 << 14):
            part = slice(i, i + (1 << 14))
            hit = (self.rows[block[part]] <= target[part, None]) & (np.arange(BLOCK) > after[part, None])
            found = hit.any(1)
            out[part] = np.where(found, block[part] * BLOCK + hit.argmax(1), -1)
        return out

    def findclose(self, opened: np.ndarray) -> np.ndarray:
        """The place that closes each of the places ``opened``."""
        target = self.excess[opened] - 1
        out = self.in_block(opened // BLOCK, target, opened % BLOCK)
        left = np.flatnonzero(out < 0)
        node, wanted = opened[left] // BLOCK + self.size, target[left]
        up = np.ones(len(node), bool)
        while up.any():  # to the first sibling on the right that goes low enough
            found = up & (node % 2 == 0) & (self.low[np.minimum(node + 1, 2 * self.size - 1)] <= wanted)
            node = np.where(found, node + 1, np.where(up, node // 2, node))
            up &= ~found
        while len(node) and node[0] < self.size * 2 and (node < self.size).any():  # and down to its first block that does
            inner = node < self.size
            first = self.low[np.where(inner, 2 * node, 0)] <= wanted
            node = np.where(inner, 2 * node + ~first, node)
        out[left] = self.in_block(node - self.size, wanted, np.full(len(node), -1))
        return out


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths share from their start."""
    n = min(len(a), len(b))
    x = np.frombuffer(a[:n], np.uint64).reshape(-1, 2)
    y = np.frombuffer(b[:n], np.uint64).reshape(-1, 2)
    off = np.flatnonzero((x != y).any(1))
    return int(off[0]) if len(off) else n // DIGEST


def least_of_ranges(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The minimum of x[begin:end] for each range (none empty)."""
    level, table = (end - begin), [x]
    while len(table[-1]) > 1 << (len(table) - 1):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    out, k = np.zeros(len(begin), x.dtype), np.frexp(level)[1] - 1
    for j in np.unique(k).tolist():
        own = np.flatnonzero(k == j)
        out[own] = np.minimum(table[j][begin[own]], table[j][end[own] - (1 << j)])
    return out


def trie(paths: list[bytes], sizes: list[np.ndarray], convs: np.ndarray, before: bytes | None, after: bytes | None) -> dict[str, np.ndarray | list]:
    """The nodes of one shard in depth-first order.  ``paths`` are sorted; ``sizes`` the bytes of each turn's text;
    ``before`` and ``after`` the neighbouring paths of other shards."""
    length = np.array([len(p) // DIGEST for p in paths])
    shared = np.array([0] + [shared_turns(a, b) for a, b in zip(paths, paths[1:])])
    fresh = length - shared
    fresh[0] += 1  # the root
    n = int(fresh.sum())
    end = np.cumsum(fresh) - 1  # node at which each conversation ends
    closing = np.concatenate([[0], length[:-1] - shared[1:], [length[-1] + 1]])
    opening = np.concatenate([fresh, [0]])
    runs = np.stack([closing, opening], 1).reshape(-1)
    bits = np.repeat(np.tile(np.array([0, 1], np.uint8), len(closing)), runs)
    depth = np.arange(n) - np.repeat(end - fresh + 1, fresh) + np.repeat(length - fresh + 1, fresh)
    opened = np.flatnonzero(bits)
    closed = Parentheses(bits).findclose(opened)
    size = (closed - opened + 1) // 2  # nodes of the subtree
    stop = np.arange(n) + size

    weight = np.zeros(n, np.int64)
    weight[1:] = np.concatenate([s[len(s) - f:] for s, f in zip(sizes, np.where(np.arange(len(paths)) == 0, fresh - 1, fresh))])
    parent, stack = np.full(n, -1), []
    for v, d in zip(range(n), depth.tolist()):
        del stack[d:]
        if d:
            parent[v] = stack[-1]
        stack.append(v)

    def on_path(of: int) -> np.ndarray:
        """The nodes from the root to a node."""
        out = []
        while of >= 0:
            out.append(of)
            of = parent[of]
        return np.array(out[::-1])

    last, first = on_path(int(end[-1])), on_path(int(end[0]))
    passed = last[: shared_turns(paths[-1], after) + 1] if after is not None else last[:0]
    taken = first[: shared_turns(paths[0], before) + 1] if before is not None else first[:0]
    owned = np.ones(n, bool)
    owned[passed] = False
    common = ~owned
    common[taken] = True

    items = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=n))])
    n_convs = items[stop] - items[:n]
    pairs = np.concatenate([[0], np.cumsum((bits[:-1] == 1) & (bits[1:] == 0)), [0]])
    leaves = pairs[closed] - pairs[opened]
    if len(passed) == len(last):  # the last leaf goes on in the next shard
        leaves[last] -= 1
    gain = np.concatenate([[0], np.cumsum(n_convs * weight - np.where(owned, weight, 0))])
    children = np.bincount(parent[1:][owned[1:]], minlength=n)
    conv = least_of_ranges(convs, items[:n], items[stop])
    return {"conv": conv, "depth": depth, "parent": parent, "n_convs": n_convs, "children": children, "leaves": leaves,
            "saved": gain[stop] - gain[:n], "common": common, "end": end, "first": first, "last": last}


def spine_keys(path: bytes, nodes: np.ndarray) -> dict[int, bytes]:
    """A digest of the path to each of the nodes on it."""
    h, out = hashlib.sha256(), {}
    for k, v in enumerate(nodes.tolist()):
        if k:
            h.update(path[(k - 1) * DIGEST: k * DIGEST])
        out[v] = h.copy().digest()[:DIGEST]
    return out


def digest_of_ids(ids) -> str:
    h = hashlib.sha256()
    for k, part in enumerate(ids):
        h.update((b"," if k else b"") + b",".join(str(c).encode() for c in part))
    return h.hexdigest()


#: Rows of the shards: nodes (``key`` where shared, ``parent_key`` where their parent is), and ends of shared nodes.
PARTS = f"{NODE}, key binary, parent_key binary, end_conv long"


def shard_rows(paths, sizes, convs, before, after):
    """Record batches of one shard."""
    t = trie(paths, sizes, convs, before, after)
    n, common, parent, end = len(t["conv"]), t["common"], t["parent"], t["end"]
    key_of = {**spine_keys(paths[0], t["first"]), **spine_keys(paths[-1], t["last"])}
    ends = np.full(n, NOTHING, object)
    begin = np.concatenate([[0], np.flatnonzero(end[1:] != end[:-1]) + 1, [len(end)]])
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if not common[end[a]]:
            ends[end[a]] = digest_of_ids([convs[a:b].tolist()])
    key = [key_of[v] if c else None for v, c in enumerate(common.tolist())]
    below = (parent >= 0) & common[parent]
    parent_key = [key_of[p] if b else None for p, b in zip(parent.tolist(), below.tolist())]
    columns = [t["conv"], t["depth"], pa.array(t["conv"][parent], mask=parent < 0), t["n_convs"], t["children"], t["leaves"], t["saved"],
               pa.array(ends, pa.string()), pa.array(key, pa.binary()), pa.array(parent_key, pa.binary()), pa.nulls(n, pa.int64())]
    names = [f.split()[0] for f in PARTS.split(", ")]
    whole = pa.table([pa.array(c) for c in columns], names=names)
    yield from whole.to_batches(1 << 16)
    own = np.flatnonzero(common[end])
    if len(own):
        schema = whole.schema
        yield from pa.table([*[pa.nulls(len(own), schema.field(k).type) for k in names[:-3]], pa.array([key_of[v] for v in end[own].tolist()], pa.binary()),
                             pa.nulls(len(own), pa.binary()), pa.array(convs[own])], schema=schema).to_batches(1 << 16)


def turns_of(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``c``, ``pos`` (from 1), ``key`` (hex digest), ``size`` (bytes of the text): the turns of every conversation in order."""
    role, text = (F.coalesce(F.col(k).cast("string"), F.lit("")) for k in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * DIGEST)
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("c", F.row_number().over(order).alias("pos"), digest.alias("key"), F.octet_length("text").cast("long").alias("size"))


def own_start(c: Column) -> Column:
    """h: how many turns of conversation c come from another one."""
    return F.crc32(c.cast("string")) % 9


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """``c``, ``path``, ``sizes`` of every rebuilt conversation: the first h turns of c - c % 5, then its own after the first h."""
    turns = materialize(turns)
    ids = turns.where("pos = 1").select("c", own_start(F.col("c")).alias("h"), (F.col("c") - F.col("c") % 5).alias("base"))
    heads = turns.where("pos <= 8").select(F.col("c").alias("base"), "pos", "key", "size")
    borrowed = heads.join(ids, "base").where("pos <= h").select("c", F.lit(0).alias("part"), "pos", "key", "size")
    own = turns.where(F.col("pos") > own_start(F.col("c"))).select("c", F.lit(1).alias("part"), "pos", "key", "size")
    turnless = ids.select("c", F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("pos"),
                          F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("size"))
    each = F.when(F.col("pos").isNotNull(), F.struct("part", "pos", "key", "size"))
    whole = borrowed.union(own).union(turnless).groupBy("c").agg(F.sort_array(F.collect_list(each)).alias("t"))
    return whole.select("c", F.unhex(F.array_join(F.col("t.key"), "")).alias("path"), F.col("t.size").alias("sizes"))


def build(paths: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``paths`` (``c``, ``path``, ``sizes``)."""
    spark = paths.sparkSession
    items = materialize(paths.repartitionByRange("path", "c").sortWithinPartitions("path", "c")
                        .withColumn("shard", F.spark_partition_id()))
    edge = F.struct("path", "c")
    bounds = items.groupBy("shard").agg(F.min(edge).alias("low"), F.max(edge).alias("high"))
    bounds = materialize(bounds.select("shard", F.col("low.path").alias("low"), F.col("high.path").alias("high")))
    shards = sorted(r[0] for r in bounds.select("shard").collect())
    near = spark.createDataFrame([*zip(shards, shards[1:], [1] * len(shards)), *zip(shards[1:], shards, [-1] * len(shards))], "shard int, other int, side int")
    guards = near.join(bounds.withColumnRenamed("shard", "other"), "other").select(
        "shard", "side", F.when(F.col("side") > 0, F.col("low")).otherwise(F.col("high")).alias("path"),
        F.lit(None).cast("array<long>").alias("sizes"), F.lit(None).cast("long").alias("c"))
    rows = items.select("shard", F.lit(0).alias("side"), "path", "sizes", "c").union(guards)

    def run(batches):
        def flush():
            if convs:
                yield from shard_rows(paths_, sizes, np.array(convs, np.int64), guard[-1], guard[1])

        at, paths_, sizes, convs, guard = None, [], [], [], {-1: None, 1: None}
        for b in batches:
            for shard, side, path, size, c in zip(*(b.column(k).to_pylist() if k != 3 else b.column(k) for k in range(5))):
                if shard != at:
                    yield from flush()
                    at, paths_, sizes, convs, guard = shard, [], [], [], {-1: None, 1: None}
                if side:
                    guard[side] = path
                else:
                    paths_.append(path)
                    sizes.append(size.values.to_numpy(zero_copy_only=False))
                    convs.append(c)
        yield from flush()

    parts = materialize(rows.repartition("shard").sortWithinPartitions("shard", "side", "path", "c").mapInArrow(run, PARTS))
    names = [f.split()[0] for f in NODE.split(", ")]
    merged = merge_spines(parts)
    here = parts.where(F.col("end_conv").isNull())
    inner = here.where(F.col("key").isNull() & F.col("parent_key").isNull()).select(*names)
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    hanging = salted_join(here.where(F.col("key").isNull() & F.col("parent_key").isNotNull()), above, ["parent_key"], ["conv_id", "depth"])
    spine = merged.join(above, "parent_key", "left")
    return inner.union(hanging.withColumn("parent_conv_id", F.col("above")).select(*names)).union(
        spine.withColumn("parent_conv_id", F.col("above")).select(*names))


def merge_spines(parts: DataFrame) -> DataFrame:
    """The shared nodes, one row each: sums over their shards, and the digest of the ids that end there, streamed in order."""
    def run(batches):
        h, of = None, None
        for b in batches:
            for key, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != of:
                    if h:
                        yield pa.RecordBatch.from_pydict({"key": pa.array([of], pa.binary()), "ends_sha256": [h.hexdigest()]})
                    h, of = hashlib.sha256(str(c).encode()), key
                else:
                    h.update(b",%d" % c)
        if h:
            yield pa.RecordBatch.from_pydict({"key": pa.array([of], pa.binary()), "ends_sha256": [h.hexdigest()]})

    shared = parts.where(F.col("key").isNotNull())
    ends = (shared.where(F.col("end_conv").isNotNull()).select("key", "end_conv").repartition("key").sortWithinPartitions("key", "end_conv")
            .mapInArrow(run, "key binary, ends_sha256 string"))
    summed = [F.sum(k).alias(k) for k in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    nodes = shared.where(F.col("end_conv").isNull()).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *summed, F.min("parent_key").alias("parent_key"))
    both = nodes.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
    return materialize(both)


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """``NODE`` for every node of the trie of all rebuilt conversations."""
    return build(rebuilt_paths(turns_of(conversations, conv_col, turn_col, role_col, text_col)))
