"""Embedding near-dedup by iterative quantisation (ITQ) and multi-index Hamming tables.

ITQ learns, on a sample bounded by ``SAMPLE`` vectors of each length, a rotation of the principal directions for which the signs
are balanced binary codes near the vectors.  Cosine has its origin at zero, so vectors are not centred: a
mean drawn to one large group would cut the group by its noise.  Every vector is coded and entered into ``TABLES`` Hamming
tables, each keyed by a substring of ``BITS`` bits of the code (the substrings start at even distances around
the code).  Vectors that meet in a bucket are compared by cosine of the original vectors in double
precision, so no link is wrong; a link is lost only if its two codes differ in every substring (at
cosine 0.98 about 4 of 64 bits differ; the tests measure recall against brute force).

A pair counts in the first table it meets in.  Copies of a vector enter once, with their number.  Buckets are never
capped: one of more than ``TILE`` rows is dealt over tiles (block x block).  A tile gives each vector's number
of links and a spanning forest of them, not all pairs.

Vectors are compared only if their labels are equal and not null.  Null, empty or zero vectors, and those that hold
null or non-finite components, link with nothing, as do vectors of different lengths.

Cases: rows without links are kept, with themselves as component; rows that share a vec_id are one node of the
graph; a null vec_id links with nothing and has a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import materialize, salted_join
from shopmetrics.llm.components import connected_components

COSINE = 0.98
#: Vectors of a length its rotation is learned from, at most; bits of a code, at most; rounds of ITQ.
SAMPLE, CODE, ROUNDS = 10_000, 64, 30
#: Hamming tables, bits of their substrings, and rows of a bucket beyond which it is dealt over tiles.
TABLES, BITS, TILE = 10, 12, 512
#: Rows of a block up to which its pairs are compared together with those of other blocks.
SMALL = 6


def learn(x: np.ndarray, code: int = CODE, rounds: int = ROUNDS, seed: int = 7) -> dict:
    """The projection (principal directions, then the learned rotation) from unit vectors.  Vectors with fewer components than
    the code has bits get several rotations, each from a start of its own and after the first with one round only: more
    rounds would bring them all to the same rotation, and the tables would share their bits."""
    _, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, : min(code, x.shape[1])]
    v, parts = x @ basis, []
    for start in range(-(-code // basis.shape[1])):
        r = np.linalg.qr(np.random.default_rng(seed + start).normal(size=(v.shape[1],) * 2))[0]
        for _ in range(1 if start else rounds):
            u, _, t = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ t).T
        parts.append(basis @ r)
    return {"projection": np.hstack(parts)[:, :code]}


def codes(x: np.ndarray, model: dict) -> np.ndarray:
    """A row of 0/1 for each unit vector of the learned length."""
    return (x @ model["projection"] >= 0).astype(np.uint8)


def table_keys(code: np.ndarray, components: int = CODE) -> np.ndarray:
    """(rows, TABLES) substrings of the code as numbers, of three bits for each component of the vectors at most."""
    n = code.shape[1]
    bits = min(BITS, n, 3 * components)
    at = (np.arange(TABLES)[:, None] * n // TABLES + np.arange(bits)) % n
    return code[:, at].astype(np.int64) @ (1 << np.arange(bits))


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length as doubles, and the same scaled to length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x, x / np.sqrt((x * x).sum(1))[:, None]


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id``, ``label``, ``vec``, ``k1``, ``k2`` (its hash) of rows that can link."""
    vec = F.col(vec_col)
    if vectors.schema[vec_col].dataType.simpleString() != "array<float>":
        vec = vec.cast("array<double>")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec.alias("vec"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
            .where(F.exists("vec", lambda v: v != 0))
            .withColumns({"k1": F.xxhash64("label", "vec"), "k2": F.xxhash64(F.lit("k"), "vec", "label")}))


def learn_codes(distinct: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The rotation of each length of vectors, from the ``sample`` vectors of it with the smallest hashes."""
    sizes = sorted(r[0] for r in distinct.select(F.size("vec")).distinct().collect())
    out = {}
    for d in sizes:
        rows = distinct.where(F.size("vec") == d).select("vec", "k1").orderBy("k1").limit(sample).collect()
        x = np.array([r["vec"] for r in rows], np.float64)
        out[d] = learn(x / np.sqrt((x * x).sum(1))[:, None])
    return out or None


def entries(distinct: DataFrame, model: dict) -> DataFrame:
    """``table``, ``key``, ``label``, ``size`` (length), ``node``, ``n``, ``vec`` and ``keys`` (in all tables): a row for each
    vector and table."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)  # a matrix of CODE columns for each length of vectors

    def run(batches):
        own = shared.value
        for b in batches:
            length = np.diff(b.column(3).offsets.to_numpy())
            for size in np.unique(length):
                some = b.take(pa.array(np.flatnonzero(length == size)))
                keys = table_keys(codes(unit(some.column(3))[1], own[int(size)]), int(size))
                n = len(keys)
                again = some.take(pa.array(np.repeat(np.arange(n), TABLES)))
                every = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * TABLES, TABLES), pa.int32()), pa.array(keys.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(TABLES, dtype=np.int32), n)), pa.array(keys.astype(np.int32).ravel()), again.column(0),
                     pa.array(np.full(n * TABLES, size, np.int32)), again.column(1), again.column(2), again.column(3),
                     every.take(pa.array(np.repeat(np.arange(n), TABLES)))],
                    names=["table", "key", "label", "size", "node", "n", "vec", "keys"])

    kind = distinct.schema["label"].dataType.simpleString()
    vec = distinct.schema["vec"].dataType.simpleString()
    return (distinct.select("label", "node", "n", "vec")
            .mapInArrow(run, f"table int, key int, label {kind}, size int, node long, n long, vec {vec}, keys array<int>"))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links i-j among n rows."""
    up, out = list(range(n)), []
    for a, b in zip(i.tolist(), j.tolist()):
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def links(rows: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """``a``, ``b`` (null on rows of figures) and ``d``: links that span each bucket, and numbers of links for nodes."""
    bucket = ["table", "key", "label", "size"]
    hot = materialize(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > tile))
    rows = rows.withColumns({"own": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    if hot.limit(1).count():
        parts = hot.select(*bucket, F.ceil(F.col("m") / tile).cast("int").alias("g"))
        both = salted_join(rows.drop("own", "i", "j"), parts, bucket, ["node"], "left")
        own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("g")).cast("int"), F.lit(0))
        other = F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("g") - 1)))
        both = both.withColumn("own", own).withColumn("other", other)
        rows = both.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "g")

    def run(batches):
        names, kept = [*bucket, "i", "j"], None
        for batch in chain(batches, [None]):  # None: no more rows
            last = batch is None
            part = pa.concat_tables([x for x in (kept, None if last else pa.Table.from_batches([batch])) if x is not None]) if kept or not last else None
            if not part:
                continue
            new = np.zeros(len(part) - 1, bool)
            for c in names:
                v = part[c].combine_chunks()
                new |= np.asarray(pc.not_equal(v[1:], v[:-1]))
            at = np.concatenate([[0], np.flatnonzero(new) + 1, [len(part)]])
            end = len(at) - 1 if last else len(at) - 2
            kept = part.slice(at[end])
            size = part["size"].to_numpy()
            for d in np.unique(size[: at[end]]):  # one length of vectors at a time
                blocks = np.flatnonzero((np.diff(at[: end + 1]) > 1) & (size[at[:end]] == d))
                if len(blocks):
                    yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in within(part, at[blocks], at[blocks + 1])], names=["a", "b", "d"])

    def within(part: pa.Table, first: np.ndarray, end: np.ndarray):
        """What blocks of two rows or more, all of one length of vectors, give: columns a, b and d."""
        rows = np.concatenate([np.arange(s, e) for s, e in zip(first, end)])
        part = part.take(pa.array(rows))
        x, u = unit(part["vec"].combine_chunks())
        keys = part["keys"].combine_chunks().flatten().to_numpy().reshape(len(x), TABLES)
        table, own, one, two, node, n = (part[c].to_numpy() for c in ("table", "own", "i", "j", "node", "n"))
        size = end - first
        start = np.cumsum(size) - size
        found = []
        for k in range(2, SMALL + 1):  # small blocks (nearly all): every pair of a block, all blocks of k rows at once
            some = start[(size == k) & (one[start] == two[start])]
            i, j = np.triu_indices(k, 1)
            i, j = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
            for m in range(0, len(i), 1 << 16):
                a, b = i[m: m + 65536], j[m: m + 65536]
                good = near(x, u, a, b, np.einsum("ij,ij->i", u[a], u[b]))
                found.append((a[good], b[good]))
        for s, k in zip(start, size):
            if k <= SMALL and one[s] == two[s]:
                continue
            a = s + np.flatnonzero(own[s: s + k] == one[s])
            b = s + np.flatnonzero(own[s: s + k] == two[s]) if one[s] != two[s] else a
            for p in range(0, len(a), 1024):
                for q in range(0, len(b), 1024):
                    i, j, c = a[p: p + 1024], b[q: q + 1024], u[a[p: p + 1024]] @ u[b[q: q + 1024]].T
                    f, g = np.nonzero(c >= cosine - 1e-9)
                    if one[s] == two[s]:
                        f, g = f[i[f] < j[g]], g[i[f] < j[g]]
                    good = near(x, u, i[f], j[g], c[f, g])
                    found.append((i[f][good], j[g][good]))
        i, j = (np.concatenate(c) for c in zip(*found))
        # A pair that shares the key of an earlier table has met there.
        new = ~((keys[i] == keys[j]) & (np.arange(TABLES) < table[i][:, None])).any(1)
        i, j = i[new], j[new]
        degree = (np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))).astype(np.int64)
        some, pairs = np.flatnonzero(degree), forest(i, j, len(x))
        return ([*node[some], *(node[p] for p, _ in pairs)], [None] * len(some) + [node[q] for _, q in pairs],
                [*degree[some]] + [0] * len(pairs))

    def near(x, u, i, j, c) -> np.ndarray:
        """Which pairs reach the threshold: ``c`` tells, and next to the threshold the cosine's own formula."""
        good = c >= cosine
        for k in np.flatnonzero(np.abs(c - cosine) < 1e-9).tolist():
            a, b = x[i[k]], x[j[k]]
            good[k] = a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine
        return good

    key = [*bucket, "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long, d long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE) -> DataFrame:
    """``id``, ``n_links`` (other rows linked directly) and ``component`` (smallest id reachable) for every row."""
    good = usable(vectors, id_col, vec_col, label_col)
    keyed = materialize(good.select("id", "k1", "k2"))
    copies = keyed.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    # One row of each group of copies carries the vector: the first with the smallest id.
    distinct = materialize(salted_join(good, copies, ["k1", "k2"], ["id"]).where(F.col("id") == F.col("node"))
                           .select("label", "node", "n", "vec", "k1", "k2").dropDuplicates(["k1", "k2"]))
    model = learn_codes(distinct)
    every = vectors.select(F.col(id_col).alias("id"))
    if model is None:
        return every.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component"))
    found = materialize(links(entries(distinct, model), cosine))
    star = connected_components(found.where("b is not null").select("a", "b"))
    degree = found.groupBy("a").agg(F.sum("d").alias("d"))
    of = (distinct.select("k1", "k2", "node", "n").join(degree, F.col("node") == F.col("a"), "left").drop("a")
          .join(star.withColumnRenamed("node", "a"), F.col("node") == F.col("a"), "left")
          .select("k1", "k2", (F.coalesce("d", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"),
                  F.coalesce("root", "node").cast("long").alias("component")))
    keys = usable(vectors, id_col, vec_col, label_col).select("id", "k1", "k2")
    linked = salted_join(keys, of, ["k1", "k2"], ["id"]).select("id", "n_links", "component")
    finite = F.forall(F.col(vec_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rest = ~(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))
             & F.coalesce(F.exists(F.col(vec_col), lambda v: v != 0), F.lit(False)))
    return linked.union(vectors.where(rest).select(F.col(id_col).alias("id"), F.lit(0).cast("long"), F.col(id_col).cast("long")))


def keep_first(found: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates`` that stay: one of each component."""
    return found.where(F.col("id") == F.col("component"))
