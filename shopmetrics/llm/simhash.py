"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has 64 bits, each the majority of that bit over the XXH64 values of its
word shingles.  Fingerprints link at ``threshold`` = 3 or fewer differing bits.

Candidate search by a covering code.  Two disjoint 31-bit parts of the fingerprint are
looked at separately: three differing bits leave at most one of them in one of the two parts.  On a
part the anchors are the words of the binary Hamming code of length 31, a perfect code of covering
radius 1: every value has exactly one anchor within distance 1 (its home).  A fingerprint is
replicated to every anchor within covering radius plus the part's threshold, 1 + 1 = 2 (16 of 2^26
anchors).  If two fingerprints differ in one bit of the part at most, the home anchor of either
is within distance 2 of the other, so homes are compared with visitors for each anchor, by the
full 64-bit distance.  Nothing is missed and nothing is capped: an anchor with more than ``TILE``
rows is dealt over tiles (home block x visitor block), and each tile emits a spanning forest
of its links, not all pairs.  Copies share one fingerprint and enter the search once.

Cases: a null or blank text has fingerprint zero and links like any other; a text of fewer words than
the shingle is one shingle; repeated rows stay in the result; a null id takes no part in the
smallest id of a component (null if there is no other); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm.common import free_name, materialize, salted_join, utf8
from shopmetrics.llm.components import connected_components

#: Rows of an anchor beyond which it is dealt over tiles.
TILE = 2048
#: Length of the perfect Hamming code, and the part of the fingerprint each table looks at.
CODE_BITS, SHIFTS = 31, (0, 31)
THRESHOLD = 3

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    start = np.cumsum(size + 1) - size - 1
    k = max(1, n - shingle + 1)
    first, last = start[:k].tolist(), (start + size)[-k:].tolist()
    of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, k, 1 << 16):
        h = np.array([of(joined[a:b], seed) for a, b in zip(first[i: i + 65536], last[i: i + 65536])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > k, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """``id``, ``t`` (a hash of the text), ``fp`` (the fingerprint's bits as a signed long) for every row; no shuffle."""
    def run(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            raw = data.tobytes()
            fp = np.fromiter((simhash(raw[s:e], shingle, seed) for s, e in zip(at[:-1], at[1:])), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64))], names=["id", "t", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("t", T.LongType()), T.StructField("fp", T.LongType())])
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t")).mapInArrow(run, schema)


def anchors_of(fp: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, 16) anchors within distance 2 of a part of each fingerprint, the first one the home
    (distance 1 at most), and a mask of those that exist (a code word has no other within 2)."""
    part = (fp.view(np.uint64) >> np.uint64(shift)) & np.uint64((1 << CODE_BITS) - 1)
    syndrome = np.zeros(len(fp), np.int64)
    for i in range(CODE_BITS):
        syndrome ^= np.where((part >> np.uint64(i)) & np.uint64(1), i + 1, 0)
    flip = np.zeros((CODE_BITS + 1, 16), np.uint64)
    for s in range(1, CODE_BITS + 1):
        pairs = [(j, j ^ s) for j in range(1, CODE_BITS + 1) if j < j ^ s]
        flip[s] = [1 << (s - 1)] + [1 << (j - 1) | 1 << (k - 1) for j, k in pairs]
    there = np.ones((len(fp), 16), bool)
    there[syndrome == 0, 1:] = False
    return part[:, None] ^ flip[syndrome], there


def replicas(distinct: DataFrame) -> DataFrame:
    """``anchor``, ``fp``, ``home`` for every fingerprint and anchor within distance 2 in a part."""
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for t, shift in enumerate(SHIFTS):
                anchor, there = anchors_of(fp, shift)
                key = (anchor | np.uint64(t << CODE_BITS)).astype(np.int64)
                home = np.zeros(there.shape, bool)
                home[:, 0] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[there]), pa.array(np.broadcast_to(fp[:, None], there.shape)[there]), pa.array(home[there])],
                    names=["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def block_links(home: np.ndarray, visitor: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of one anchor."""
    near = np.bitwise_count(home[:, None] ^ visitor[None, :]) <= threshold
    out, left = [], np.ones(len(home), bool)
    for i in range(len(home)):
        if not left[i]:
            continue
        left[i], reach, front = False, np.zeros(len(visitor), bool), np.array([i])
        while len(front):
            new = near[front].any(0) & ~reach
            reach |= new
            front = np.flatnonzero(left & near[:, new].any(1))
            left[front] = False
            out += [(home[i], x) for x in home[front]]
        out += [(home[i], x) for x in visitor[reach]]
    return [(a, b) for a, b in out if a != b]


def links(rows: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``a``, ``b``: links between fingerprints that connect every pair of rows of an anchor
    within ``threshold`` bits."""
    rows = rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    hot = materialize(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile))
    if hot.limit(1).count():
        parts = F.ceil(F.col("n") / tile).cast("int")
        both = salted_join(rows.drop("i", "j"), hot.select("anchor", parts.alias("g")), ["anchor"], ["fp"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        every = F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("g") - 1))
        both = both.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(every))
        # A home row meets every visitor block; a visiting row (homes visit too) every home block.
        as_home = both.where("home").select("anchor", "fp", F.lit(True).alias("home"), F.col("own").alias("i"), F.col("other").alias("j"))
        as_guest = both.select("anchor", "fp", F.lit(False).alias("home"), F.col("other").alias("i"), F.col("own").alias("j"))
        rows = as_home.union(as_guest)

    def run(batches):
        kept = None
        for b in batches:
            part = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if kept is not None:
                part = [np.concatenate(x) for x in zip(kept, part)]
            a, _, _, i, j = part
            new = np.flatnonzero((a[1:] != a[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if not len(new):
                kept = part
                continue
            yield from within([x[: new[-1]] for x in part], np.concatenate([[0], new]))
            kept = [x[new[-1]:] for x in part]
        if kept is not None and len(kept[0]):
            yield from within(kept, np.array([0, len(kept[0])]))

    def within(part, bounds):
        _, fp, home, _, _ = part
        fp, found, size = fp.view(np.uint64), [], np.diff(bounds)
        homes = np.add.reduceat(home.astype(np.int64), bounds[:-1])
        # Small blocks (nearly all): every home row against every row of the block, all blocks at once.
        work = homes * size
        small = (work > 1) & (work <= 64)
        block = np.repeat(np.arange(len(size)), size)
        h = np.flatnonzero(home & small[block])
        times = size[block[h]]
        x = np.repeat(h, times)
        y = np.repeat(bounds[:-1][block[h]], times) + np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times)
        keep = (fp[x] != fp[y]) & (np.bitwise_count(fp[x] ^ fp[y]) <= threshold)
        found.append((fp[x][keep], fp[y][keep]))
        for k in np.flatnonzero(work > 64):
            block_fp, is_home = fp[bounds[k]: bounds[k + 1]], home[bounds[k]: bounds[k + 1]]
            pairs = block_links(block_fp[is_home], block_fp, threshold)
            if pairs:
                found.append(tuple(np.array(c, np.uint64) for c in zip(*pairs)))
        a, b = (np.concatenate(c) for c in zip(*found))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    key = ["anchor", "i", "j"]
    return (rows.select("anchor", "fp", "home", "i", "j").repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    threshold: int = THRESHOLD, seed: int = 42) -> DataFrame:
    """``id``, ``fp``, ``component`` (smallest id reachable by links, itself included) for every
    row of ``docs``.  ``threshold`` is at most 3, the bound the two parts stand for."""
    if not 0 <= threshold <= 3:
        raise ValueError("the two parts of one covering radius find distances up to 3")
    return _grouped(docs, id_col, text_col, shingle, threshold, seed).select("id", "fp", "component")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int, seed: int) -> DataFrame:
    """``id``, ``t`` (hash of the text), ``fp``, ``root`` (a fingerprint of the component), ``component``."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle, seed))
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("low")))
    star = connected_components(links(replicas(distinct), threshold))
    root = distinct.join(star, distinct.fp == star.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low = root.groupBy("root").agg(F.min("low").alias("component"))
    of = salted_join(root.select("fp", "root"), low, ["root"], ["fp"]).select("fp", "root", "component")
    return salted_join(fps, of, ["fp"], ["id"]).select("id", "t", "fp", "root", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD,
             seed: int = 42) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id, and of several rows of the
    group with that id one.  Rows of one id with unlike texts are of different groups, and each group keeps its own.  Rows
    whose id is null stay."""
    if not 0 <= threshold <= 3:
        raise ValueError("the two parts of one covering radius find distances up to 3")
    found = _grouped(docs, id_col, text_col, shingle, threshold, seed)
    first = found.where(F.col("id") == F.col("component")).groupBy("root", "id", "t").agg(F.count(F.lit(1)).alias("n"))
    rest = materialize(first.groupBy("root").agg(F.min(F.struct("id", "t", "n")).alias("m")).select("m.*"))
    own, k, t, n = (free_name(docs, f"kept_{x}") for x in ("own", "id", "t", "n"))
    named = docs.where(F.col(id_col).isNotNull()).withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    # The ids grow with the documents, so they are merged at every size and never broadcast at some.
    kept = named.join(rest.select(F.col("id").alias(k), F.col("t").alias(t), F.col("n").alias(n)).hint("merge"),
                      (F.col(id_col) == F.col(k)) & (F.col(own) == F.col(t)))
    if rest.where("n > 1").limit(1).count():
        kept = kept.where(F.col(n) == 1).union(kept.where(F.col(n) > 1).dropDuplicates([k, t]))
    return kept.drop(own, k, t, n).union(docs.where(F.col(id_col).isNull()))
