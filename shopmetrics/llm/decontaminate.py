"""Benchmark decontamination with training suffix arrays.

Every task cuts its documents into shards of bounded size and builds one word-level suffix array
for each shard; every test suffix is found in it by binary search (all suffixes in lockstep).  Equal
suffixes are neighbours, so a search gives all places of a test window at once; windows that
follow each other in document and item join to the longest verbatim match.  Suffixes that start at a
word no item has, or lie in a run of item words shorter than the shortest window, can match
nothing and are left out of the array.  Words are compared by 64-bit hash first, and every word
that gets into the array is then compared byte by byte, so matches are exact.

The documents are never shuffled.  The benchmark is a stated query set: it is read in blocks of
``BLOCK_BYTES`` of text, each broadcast by itself, and every shard is searched for one block after another.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is ``n`` words in a row
of an item; an item of fewer words, but not none, is one window.

Cases: a null or wordless text has no words, no hits, and is never contaminated; a null or wordless
item has no windows; items of equal text all count; a null item id hits words but is not listed;
repeated documents are judged alike; empty tables give no rows or no hits.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm.common import append_columns, free_prefix, pieces, utf8

WINDOW = 13
#: Bytes of document text in one suffix array, and of benchmark text in one broadcast.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 16 << 20
#: Share of hit words from which a document is contaminated: 1 of 20.
SHARE = 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IS_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])


def multipliers(places: np.ndarray | None = None) -> np.ndarray:
    """One odd 64-bit factor for each of the first 4096 places in a word, or for ``places``."""
    places = np.arange(4096) if places is None else places
    x = (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x | np.uint64(1)


def words_of(data: np.ndarray, at: np.ndarray, factor: np.ndarray):
    """Lower-cased bytes, starts and ends of words, and a hash of each word."""
    low = _LOWER[data]
    is_word = _IS_WORD[low]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    inner = at[(at > 0) & (at < len(data))]
    first[inner], last[inner - 1] = is_word[inner], is_word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return low, start, end, np.zeros(0, np.uint64)
    size = end - start
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    times = factor[place & 4095]
    far = np.flatnonzero(place > 4095)
    if len(far):
        times[far] = multipliers(place[far])
    value = (low[is_word].astype(np.uint64) + np.uint64(1)) * times
    return low, start, end, np.add.reduceat(value, begin)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``ids`` above zero, sorted by the next ``depth`` ids at least (prefix doubling); the end comes before
    every id."""
    rank, step = ids.astype(np.int64), 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step *= 2
        if step >= len(rank):
            break
    order = np.argsort(rank, kind="stable")
    return order[ids[order] > 0]


class TestBlock:
    """The windows of a block of the benchmark: its vocabulary, the different windows, and where
    each of them occurs in the items."""

    def __init__(self, rows: list[tuple[list[str], str]], n: int):
        items = [([i for i in names if i is not None], _WORD.findall(text.encode().translate(_LOWER.tobytes()))) for names, text in rows]
        items = [(names, words) for names, words in items if words]
        self.n, self.names = n, [names for names, _ in items]
        vocabulary = sorted({w for _, words in items for w in words})
        factor = multipliers()
        joined = np.frombuffer(b" ".join(vocabulary), np.uint8)
        hashes = words_of(joined, np.array([0, len(joined)]), factor)[3]
        order = np.argsort(hashes, kind="stable")
        self.vocabulary, self.hashes = [vocabulary[i] for i in order], hashes[order]
        self.known = np.zeros(1 << 16, bool)
        self.known[self.hashes >> np.uint64(48)] = True
        code = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        place = 0
        for k, (_, words) in enumerate(items):
            ids, size = [code[w] for w in words], min(n, len(words))
            for i in range(len(ids) - size + 1):
                found.setdefault(tuple(ids[i: i + size]), []).append((k, place + i))
            place += len(ids) + 1
        self.size = np.array([len(w) for w in found], np.int64)
        self.windows = np.zeros((len(found), n), np.int64)
        for r, w in enumerate(found):
            self.windows[r, : len(w)] = w
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in found.values()])]).astype(np.int64)
        self.item = np.array([k for x in found.values() for k, _ in x], np.int64)
        self.place = np.array([p for x in found.values() for _, p in x], np.int64)

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary number (from 1) of the first word of each hash, or 0."""
        out = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.known[hashes >> np.uint64(48)])
        i = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        out[some] = np.where(self.hashes[i] == hashes[some], i + 1, 0)
        return out

    def search(self, low, start, end, doc, hashes):
        """Places (word numbers) of windows in a shard, and the numbers of the windows."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.size) or not len(start):
            return none
        code, least = self.codes(hashes), int(self.size.min())
        keep = in_runs(code, doc, least)
        if not len(keep):
            return none
        for k in keep.tolist():
            c, word = int(code[k]), low[start[k]: end[k]].tobytes()
            while c and word != self.vocabulary[c - 1]:  # then the next word of the same hash, if there is one
                c = c + 1 if c < len(self.hashes) and self.hashes[c] == self.hashes[c - 1] else 0
            code[k] = c
        keep = in_runs(code, doc, least)
        if not len(keep):
            return none
        gap = np.ones(len(keep), np.int64)
        gap[1:] = 1 + ((keep[1:] != keep[:-1] + 1) | (doc[keep[1:]] != doc[keep[:-1]]))
        to = np.cumsum(gap) - 1
        ids = np.zeros(int(to[-1]) + 1, np.int64)
        ids[to] = code[keep]
        array = suffix_array(ids, self.n)
        padded = np.concatenate([ids, np.zeros(self.n, np.int64)])
        live = self.possible(code[keep])
        lower, upper = self.bound(array, padded, live, False), self.bound(array, padded, live, True)
        count = upper - lower
        window = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
        back = np.zeros(len(ids), np.int64)
        back[to] = keep
        return back[array[lower[window] + nth]], live[window]

    def possible(self, codes: np.ndarray) -> np.ndarray:
        """The windows all of whose words are in a shard; others needn't be searched."""
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[codes] = there[0] = True  # 0 fills up short windows
        live = np.flatnonzero(there[self.windows[:, 0]])
        return live[there[self.windows[live]].all(1)]

    def bound(self, array, padded, live, upper: bool) -> np.ndarray:
        """Binary search of the windows ``live`` at once, comparing as many words as each has."""
        lo, hi, windows = np.zeros(len(live), np.int64), np.full(len(live), len(array)), self.windows[live]
        cols = np.arange(self.n)
        used, rows = cols[None, :] < self.size[live, None], np.arange(len(live))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            there = padded[array[np.minimum(mid, len(array) - 1)][:, None] + cols]
            differs = (there != windows) & used
            at = differs.argmax(1)
            right = there[rows, at] < windows[rows, at]
            if upper:
                right |= ~differs.any(1)
            right &= lo < hi
            lo, hi = np.where(right, mid + 1, lo), np.where(right | (lo >= hi), hi, mid)
        return lo


def in_runs(code: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the words in runs of at least ``least`` known words of one document."""
    known = np.flatnonzero(code)
    if not len(known):
        return known
    new = np.ones(len(known), bool)
    new[1:] = (known[1:] != known[:-1] + 1) | (doc[known[1:]] != doc[known[:-1]])
    run = np.cumsum(new) - 1
    return known[np.bincount(run)[run] >= least]


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
          T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest_match", T.LongType()),
          T.StructField("longest_at", T.LongType())]


def judge_shard(data: np.ndarray, at: np.ndarray, blocks: list[TestBlock], factor: np.ndarray) -> list[tuple]:
    """For each text of a shard: words, hit words, names of the items with occurring windows, words of
    the longest verbatim match and the number of its first word (null if there is none)."""
    low, start, end, hashes = words_of(data, at, factor)
    n = len(at) - 1
    doc = np.searchsorted(at, start, "right") - 1
    begin = np.searchsorted(doc, np.arange(n + 1))
    cover, names = np.zeros(len(start) + 1, np.int64), [set() for _ in range(n)]
    best, best_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for block in blocks:
        place, window = block.search(low, start, end, doc, hashes)
        if not len(place):
            continue
        size = block.size[window]
        np.add.at(cover, place, 1)
        np.add.at(cover, place + size, -1)
        for d, w in zip(*(x.tolist() for x in np.divmod(np.unique(doc[place] * len(block.size) + window), len(block.size)))):
            for k in block.item[block.begin[w]: block.begin[w + 1]]:
                names[d].update(block.names[k])
        # Windows that follow each other in the document and in an item lie on one diagonal.
        times = block.begin[window + 1] - block.begin[window]
        of = np.repeat(np.arange(len(place)), times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        p, q = place[of], block.place[block.begin[window[of]] + nth]
        order = np.lexsort((p, p - q))
        p, q, of = p[order], q[order], of[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1) | (doc[p[1:]] != doc[p[:-1]])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(p))) - 1 + size[of[first]]
        for d, m, f in sorted(zip(doc[p[first]].tolist(), length.tolist(), p[first].tolist()), key=lambda x: (x[1], -x[2])):
            if m > best[d] or m == best[d] and f - begin[d] < best_at[d]:
                best[d], best_at[d] = m, f - begin[d]
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    n_hit, n_words = (hit[begin[1:]] - hit[begin[:-1]]).tolist(), np.diff(begin).tolist()
    return [(n_words[d], n_hit[d], sorted(names[d]), int(best[d]) or None, int(best_at[d]) if best[d] else None) for d in range(n)]


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, n: int, block_bytes: int) -> list:
    """The benchmark as broadcast blocks of about ``block_bytes`` of text each; one text is never split."""
    spark = benchmark.sparkSession
    b = (benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
         .where("text is not null").groupBy("text").agg(F.collect_set("id").alias("ids")))
    size = b.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    k = math.ceil(size / block_bytes)
    out = []
    for i in range(k):
        rows = b.where(F.pmod(F.xxhash64("text"), F.lit(k)) == i).collect()
        out.append(spark.sparkContext.broadcast(TestBlock([(r["ids"], r["text"]) for r in rows], n)))
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text", n: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                 prefix: str = "") -> DataFrame:
    """``docs`` with ``FIELDS`` appended (names after ``prefix``)."""
    blocks = test_blocks(benchmark, item_col, item_text_col, n, block_bytes)
    where = docs.columns.index(text_col)
    fields = [T.StructField(prefix + f.name, f.dataType) for f in FIELDS]

    def of_task():
        factor, own = multipliers(), [b.value for b in blocks]

        def of_batch(batch):
            data, at = utf8(batch.column(where))
            found = []
            for i, j in pieces(at, SHARD_BYTES):
                found += judge_shard(data[at[i]: at[j]], at[i: j + 1] - at[i], own, factor)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64()]
            return [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)]

        return of_batch

    return append_columns(docs, fields, of_task)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: int = SHARE, **options) -> DataFrame:
    """``docs`` without contaminated ones: those with hit words, 1 of ``share`` of all words at least."""
    prefix = free_prefix(docs, "match_", FIELDS)
    found = find_matches(docs, benchmark, text_col, prefix=prefix, **options)
    hit, words = F.col(f"{prefix}n_hit"), F.col(f"{prefix}n_words")
    return found.where(~((hit > 0) & (share * hit >= words))).drop(*[prefix + f.name for f in FIELDS])

