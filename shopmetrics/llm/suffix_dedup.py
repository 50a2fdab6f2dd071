"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` = 100 bytes that also starts earlier go.

A distributed merge sort of sampled suffixes, aware of common prefixes:

1. Sampled starts.  In each window of 100 bytes the 32-byte gram with the smallest hash is its anchor (ties: the first
   one).  A window is looked after by one suffix start: its anchor, if that lies 34 bytes into it at most, else the place
   35 bytes before the anchor.  So a start is chosen by the window's own bytes: equal windows, wherever they are,
   have it at the same offset, and their suffixes there share 66 bytes at least.  About 1 of 26 places is a start.
2. A suffix whose first 66 bytes occur once can repeat nothing.  64-bit hashes of these bytes are counted over the whole
   corpus (each task sends a hash twice at most for each bucket of documents), and only repeated ones go on.
3. Every bucket of documents sorts its suffixes (to the end of the last window, 100 bytes at most) to a run; equal ones
   are reduced to the first, and the others are known to be repeats.  Runs are front-coded (length of the prefix
   shared with the suffix before, and the rest), cut at splitters drawn from a sample of suffixes, and exchanged by range.
4. Every range is merged by a loser tree.  A suffix carries the length of the prefix it shares with the last one put
   out; the longer shared prefix wins without a look at the bytes, and equal ones are compared from there on only.
   The merge thus yields the suffixes in order with their common prefix lengths.
5. Neighbours that share 66 bytes are a group.  Equal suffixes with equal bytes before them repeat the first one
   whole.  Others share the windows for which the common bytes before and after the start make up 100.
   A start whose 66 bytes occur over ``BIG`` times doesn't enter the merge, as all such suffixes would meet in one task:
   each bucket sends the first of each of its windows as a 128-bit BLAKE2b hash with id and place, dealt by hash,
   and all but the first of a hash are repeats (equal windows have the same start, so they all go this way).
6. The covered bytes return to the buckets and are cut out of the texts.

Texts are read as UTF-8 bytes; matches never cross documents; the order is by id, then place.  All texts are
processed whole; nothing is capped.  A passage shared by a third of all documents is reduced to one suffix a bucket before
it is exchanged.

Cases: a null text is read as empty; texts under 100 bytes never lose anything; rows with the same id are separate
documents, in the order of their texts; a null id comes first; ids must be integers; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import materialize, utf8

LENGTH, GRAM, HALF = 100, 32, 34
#: Bytes two windows looked after by the same start share from there on, at least.
PREFIX = LENGTH - HALF
#: Window starts hashed at a time, and bytes of text in a bucket of documents.
SLICE, BUCKET_BYTES = 1 << 19, 32 << 20
#: Sampled suffixes for each range, bytes of them in a splitter, and ranges, at most: the driver sees
#: SAMPLE * SPLITTER * RANGES bytes (50 MB), and every task SPLITTER * RANGES (1.5 MB).
SAMPLE, SPLITTER, RANGES = 32, 24, 1 << 16
#: Suffixes of a group beyond which its windows are compared in arrays, and starts with the same first bytes beyond
#: which their windows are dealt over all tasks instead.
SMALL, BIG = 12, 1 << 14

_A, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def byte_codes() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(_A)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM and of the PREFIX bytes that start at each place."""
    power, h, size, of_2 = np.uint64(_A), codes[data], 1, None
    while size < 64:
        h = h[:-size] * power + h[size:] if len(h) > size else h[:0]
        power = np.uint64(int(power) ** 2 % 2**64)
        size *= 2
        if size == 2:
            of_2, power_2 = h, power
        if size == GRAM:
            gram = h
    n = max(0, len(data) - PREFIX + 1)
    prefix = h[:n] * power_2 + of_2[64: 64 + n]
    return gram, prefix


def suffixes(data: np.ndarray, end: np.ndarray, codes: np.ndarray):
    """For texts one after the other (``end``: the place after each text's last byte): the sampled suffixes as arrays of
    start, first and last window start, and prefix hash."""
    out = []
    span = LENGTH - GRAM + 1
    for p in range(0, len(data) - LENGTH + 1, SLICE):
        part = data[p: p + SLICE + LENGTH - 1]
        n = len(part) - LENGTH + 1
        gram, prefix = gram_hashes(part, codes)
        gram = gram ^ (gram >> np.uint64(31))
        key = gram * np.uint64(_MIX)
        key = (key >> np.uint64(20) << np.uint64(20)) | np.arange(len(key), dtype=np.uint64)
        low, size = key, 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[: len(low) - (span - size)], low[span - size:]) if span > size else low
        anchor = (low[:n] & np.uint64((1 << 20) - 1)).astype(np.int64)
        window = np.arange(n)
        start = np.where(anchor - window <= HALF, anchor, anchor - HALF - 1)
        text = np.searchsorted(end, window + p, "right")
        good = window + p + LENGTH <= end[np.minimum(text, len(end) - 1)]
        new = np.ones(n, bool)
        new[1:] = (start[1:] != start[:-1]) | (good[1:] != good[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        keep = good[first]
        first, last = first[keep], last[keep]
        s = start[first]
        out.append((s + p, first + p, last + p, prefix[s]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def repeated_hashes(docs: DataFrame, buckets: int, rate: float, big: int) -> DataFrame:
    """``bucket``, ``hashes`` (sorted 64-bit prefix hashes that occur twice or more in the corpus and in documents of the
    bucket), ``many`` (those that occur over ``big`` times); rows with bucket -1 hold a sample of the suffixes' first bytes
    instead."""
    cut = int(rate * 2**32)

    def send(batches):
        codes = byte_codes()
        for b in batches:
            data, at = utf8(b.column(1))
            bucket = b.column(0).to_numpy()
            s, first, _, h = suffixes(data, at[1:], codes)
            if not len(s):
                continue
            own = bucket[np.searchsorted(at[1:], first, "right")].astype(np.int32)
            order = np.lexsort((own, h))
            s, h, own = s[order], h[order], own[order]
            same = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
            third = np.zeros(len(h), bool)
            third[2:] = same[1:] & same[:-1]
            drawn = np.flatnonzero((h * np.uint64(_MIX) >> np.uint64(32)).astype(np.int64) < cut)
            some = [data[x: x + SPLITTER].tobytes() for x in s[drawn[:: max(1, len(drawn) // (16 * SAMPLE))]].tolist()]
            more, times = np.unique(h[third], return_counts=True)
            h, own = h[~third], own[~third]
            edge, edge_2 = (np.searchsorted(((x >> np.uint64(32)).astype(np.int64) * buckets) >> 32, np.arange(buckets + 1)) for x in (h, more))
            rows = [k for k in range(buckets) if edge[k] < edge[k + 1]]
            blobs = [h[edge[k]: edge[k + 1]].tobytes() + own[edge[k]: edge[k + 1]].tobytes() for k in rows]
            left_out = [more[edge_2[k]: edge_2[k + 1]].tobytes() + times[edge_2[k]: edge_2[k + 1]].tobytes() for k in rows]
            if some:
                rows, blobs, left_out = [*rows, -1], [*blobs, b"".join(x.ljust(SPLITTER, b"\0") for x in some)], [*left_out, b""]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary()), pa.array(left_out, pa.binary())],
                                             names=["place", "blob", "left_out"])

    def count(key, table):
        blobs = table["blob"].to_pylist()
        if key[0].as_py() < 0:
            return pa.table({"bucket": pa.array([-1] * len(blobs), pa.int32()), "hashes": pa.array(blobs, pa.binary()),
                             "many": pa.nulls(len(blobs), pa.binary())})
        h = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 12) for x in blobs])
        own = np.concatenate([np.frombuffer(x, np.int32, len(x) // 12, len(x) // 12 * 8) for x in blobs])
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        kinds, times = np.unique(h, return_counts=True)
        for x in table["left_out"].to_pylist():
            times[np.searchsorted(kinds, np.frombuffer(x, np.uint64, len(x) // 16))] += np.frombuffer(x, np.int64, len(x) // 16, len(x) // 2)
        many = kinds[times > big]
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        h, own = h[twice], own[twice]
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else np.zeros(1, np.int64)
        found = [np.unique(h[a:b]) for a, b in zip(edge[:-1], edge[1:])]
        return pa.table({"bucket": pa.array(own[edge[:-1]], pa.int32()), "hashes": pa.array([x.tobytes() for x in found], pa.binary()),
                         "many": pa.array([x[np.isin(x, many)].tobytes() for x in found], pa.binary())})

    sent = docs.select("bucket", "text").mapInArrow(send, "place int, blob binary, left_out binary")
    return sent.groupBy("place").applyInArrow(count, "bucket int, hashes binary, many binary")


def texts_of(table: pa.Table):
    """The documents of a bucket in order: ids (null as the smallest number), bytes, ends, and a key that orders documents of one
    id."""
    ids = table["id"].cast(pa.int64()).combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False) if len(ids) else np.zeros(0, bool)
    number = np.where(known, ids.fill_null(0).to_numpy(zero_copy_only=False), np.iinfo(np.int64).min) if len(ids) else np.zeros(0, np.int64)
    raw, at = utf8(table["text"].cast(pa.large_string()))
    whole = raw.tobytes()
    text = [whole[a:b] for a, b in zip(at[:-1], at[1:])]
    order = sorted(range(len(text)), key=lambda k: (number[k], text[k]))
    number, known, text = number[order], known[order], [text[k] for k in order]
    nth = np.zeros(len(text), np.int64)
    for k in range(1, len(text)):
        if number[k] == number[k - 1]:
            nth[k] = nth[k - 1] + 1
    return number, known, nth, text, np.cumsum([len(t) for t in text], dtype=np.int64)


def pack_run(entries: list[tuple], shared: list[int]) -> bytes:
    """A run of (suffix, bytes before, id, place), front-coded by the prefix lengths ``shared``."""
    n = len(entries)
    head = np.array([n], np.int64).tobytes()
    sizes = np.array([[k, len(e[0]), len(e[1])] for e, k in zip(entries, shared)], np.uint8).tobytes()
    where = np.array([e[2:4] for e in entries], np.int64).tobytes()
    return b"".join([head, sizes, where, *[e[0][k:] for e, k in zip(entries, shared)], *[e[1] for e in entries]])


def read_run(blob: bytes):
    """(suffix, bytes before, id, place, length of the prefix shared with the one before) of a packed run, in order."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.uint8, 3 * n, 8).reshape(n, 3).tolist()
    where = np.frombuffer(blob, np.int64, 2 * n, 8 + 3 * n).reshape(n, 2).tolist()
    at = 8 + 19 * n
    left = at + sum(size - k for k, size, _ in sizes)
    before = b""
    for (k, size, more), (doc, place) in zip(sizes, where):
        before = before[:k] + blob[at: at + size - k]
        at += size - k
        yield before, blob[left: left + more], doc, place, k
        left += more


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which ``at`` bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7 >> 3)


def merge(runs):
    """Loser-tree merge of runs in the order of (suffix, bytes before, id, place).  Yields each entry with the
    length of the prefix it shares with the one put out before, and the number of its run.

    A head is [entry, shared], ``shared`` the common prefix with the entry that last went up past it."""
    runs = [iter(r) for r in runs]
    size = 1
    while size < max(1, len(runs)):
        size *= 2
    heads: list = [None] * size
    for k, r in enumerate(runs):
        e = next(r, None)
        heads[k] = None if e is None else [e, 0]

    def beats(a: int, b: int) -> bool:
        """Whether head a comes before head b; the loser then has its prefix shared with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return True
        if x is None:
            return False
        if x[1] != y[1]:
            return x[1] > y[1]  # the loser shares no more with the winner than with the one before
        s, t = x[0][0], y[0][0]
        k = common(s, t, x[1])
        if k < len(s) and k < len(t):
            first = s[k] < t[k]
        elif len(s) != len(t):
            first = len(s) < len(t)
        else:
            first = x[0][1:4] <= y[0][1:4]
        (y if first else x)[1] = k
        return first

    tree = [0] * size  # the losers at the inner nodes

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        if beats(a, b):
            tree[node] = b
            return a
        tree[node] = a
        return b

    win = build(1)
    while heads[win] is not None:
        entry, shared = heads[win]
        yield entry, shared, win
        e = next(runs[win], None)
        heads[win] = None if e is None else [e, e[4]]
        node = (win + size) // 2
        while node:
            if beats(tree[node], win):
                tree[node], win = win, tree[node]
            node //= 2


def windows_shared(group: list[tuple]) -> list[tuple[int, int, int]]:
    """group: (suffix, bytes before, id, place, prefix shared with the one before, run), all different, in order.  Spans (number
    in the group, first and last offset before the start) of windows that an earlier one also has."""
    order = sorted(range(len(group)), key=lambda k: group[k][2:4])
    out = []
    if len(group) <= SMALL:
        for n, k in enumerate(order):
            right, left = group[k][0], group[k][1]
            for m in order[:n]:
                r = min(g[4] for g in group[min(k, m) + 1: max(k, m) + 1])
                other = group[m][1]
                l = common(left[::-1], other[::-1])
                a = LENGTH - min(r, len(right), len(group[m][0]))
                if a <= l:
                    out.append((k, a, l))
        return out
    n = len(group)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    shared = np.array([0] + [g[4] for g in group[1:]])
    right, left = np.array([len(g[0]) for g in group]), np.array([len(g[1]) for g in group])
    back = [g[1][::-1] for g in group]
    by_left = sorted(range(n), key=back.__getitem__)
    left_shared = np.array([0] + [common(back[a], back[b]) for a, b in zip(by_left, by_left[1:])])
    again = np.zeros((n, HALF + 2), bool)
    for o in range(HALF + 1):
        there = np.flatnonzero((right >= LENGTH - o) & (left >= o))
        if len(there) < 2:
            continue
        of_right = np.cumsum(shared < LENGTH - o)
        of_left = np.empty(n, np.int64)
        of_left[by_left] = np.cumsum(left_shared < o)
        there = there[np.argsort(rank[there])]
        _, first = np.unique(of_right[there] * (n + 1) + of_left[there], return_index=True)
        seen = np.ones(len(there), bool)
        seen[first] = False
        again[there[seen], o] = True
    step = np.diff(again.astype(np.int8), axis=1, prepend=0)
    k, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return list(zip(k.tolist(), a.tolist(), (b - 1).tolist()))


def firsts(digest: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows by hash, id and place, and which of them (in it) aren't the first of their hash."""
    order = np.lexsort((where[:, 1], where[:, 0], digest[:, 1], digest[:, 0]))
    again = np.zeros(len(order), bool)
    again[1:] = (digest[order[1:]] == digest[order[:-1]]).all(1)
    return order, again


def hashed_windows(entries: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different windows of (suffix, bytes before, id, place) as hashes and (id, place) of the first, by hash, and
    (id, first and last place) of the others.  Equal windows lie at the same offset before their start."""
    digests, wheres, repeats = [np.zeros((0, 2), np.uint64)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 3), np.int64)]
    for o in range(HALF + 1):
        there = [e for e in entries if len(e[0]) >= LENGTH - o and len(e[1]) >= o]
        if not there:
            continue
        digest = np.frombuffer(b"".join([hashlib.blake2b(e[1][len(e[1]) - o:] + e[0][: LENGTH - o], digest_size=16).digest() for e in there]), np.uint64).reshape(-1, 2)
        where = np.array([(e[2], e[3] - o) for e in there], np.int64)
        order, again = firsts(digest, where)
        digests.append(digest[order[~again]])
        wheres.append(where[order[~again]])
        rest = where[order[again]]
        repeats.append(np.column_stack([rest, rest[:, 1] + LENGTH]))
    digest, where = np.concatenate(digests), np.concatenate(wheres)
    order = np.argsort(digest[:, 0], kind="stable")
    return digest[order], where[order], np.concatenate(repeats)


def covered(docs: DataFrame, buckets: int, rate: float, ranges: int, big: int) -> DataFrame:
    """``bucket``, ``spans`` (packed id, first and last place covered)."""
    found = materialize(repeated_hashes(docs.select("bucket", "text"), buckets, rate, big))
    drawn = sorted(x[k: k + SPLITTER] for r in found.where("bucket < 0").select("hashes").collect() for x in [bytes(r[0])] for k in range(0, len(x), SPLITTER))
    splitters = sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []
    shared = docs.sparkSession.sparkContext.broadcast(splitters)  # bounded: SPLITTER * RANGES bytes

    def runs(key, left, right):
        bucket = key[0].as_py()
        number, _, nth, text, end = texts_of(left)
        whole = b"".join(text)
        known = [np.frombuffer(x, np.uint64) for x in right["hashes"].to_pylist()]
        rows, blobs, local, crowd = [], [], [], []
        if known and whole:
            known = np.sort(np.concatenate(known))
            s, first, last, h = suffixes(np.frombuffer(whole, np.uint8), end, byte_codes())
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            keep = known[at] == h
            s, first, last = s[keep], first[keep], last[keep]
            many = np.isin(h[keep], np.frombuffer(b"".join(right["many"].to_pylist()), np.uint64))
            doc = np.searchsorted(end, first, "right")
            begin = (end - np.array([len(t) for t in text], np.int64))[doc]
            place = (s - begin) + (nth[doc] << 40)
            entries = [(whole[a: c + LENGTH], whole[b:a], i, p, m)
                       for a, b, c, i, p, m in zip(s.tolist(), first.tolist(), last.tolist(), number[doc].tolist(), place.tolist(), many.tolist())]
            entries.sort()
            kept, lengths, cuts, cut = [], [], shared.value, 0
            bounds, before = [], (b"", b"")
            for e in entries:
                if before[0] == e[0] and before[1] == e[1]:
                    local.append((e[2], e[3] - len(e[1]), e[3] - (LENGTH - len(e[0])) + LENGTH))
                    continue
                before = e
                if e[4]:
                    crowd.append(e)
                    continue
                while cut < len(cuts) and cuts[cut] <= e[0][:SPLITTER]:
                    cut += 1
                if not bounds or bounds[-1][0] != cut:
                    bounds.append((cut, len(kept)))
                    lengths.append(0)
                else:
                    lengths.append(common(kept[-1][0], e[0]))
                kept.append(e)
            for (cut, a), (_, b) in zip(bounds, [*bounds[1:], (0, len(kept))]):
                rows.append(cut)
                blobs.append(pack_run(kept[a:b], lengths[a:b]))
        spans = [np.array(local, np.int64).tobytes()] if local else []
        if crowd:
            digest, where, repeats = hashed_windows(crowd)
            spans = [b"".join([*spans, repeats.tobytes()])]
            edge = np.searchsorted(((digest[:, 0] >> np.uint64(32)).astype(np.int64) * buckets) >> 32, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edge)).tolist():
                rows.append(ranges + k)
                blobs.append(digest[edge[k]: edge[k + 1]].tobytes() + where[edge[k]: edge[k + 1]].tobytes())
        return pa.table({"range": pa.array(rows + [-1 - bucket] * len(spans), pa.int32()), "bucket": pa.array([bucket] * (len(rows) + len(spans)), pa.int32()),
                         "blob": pa.array(blobs + spans, pa.binary())})

    def resolve(key, table):
        buckets_of, blobs = table["bucket"].to_pylist(), table["blob"].to_pylist()
        if key[0].as_py() < 0:
            return table.select(["bucket", "blob"]).rename_columns(["bucket", "spans"])
        if key[0].as_py() >= ranges:
            digest = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 16).reshape(-1, 2) for x in blobs])
            where = np.concatenate([np.frombuffer(x, np.int64, len(x) // 16, len(x) // 2).reshape(-1, 2) for x in blobs])
            order, again = firsts(digest, where)
            order = np.sort(order[again])
            edge = np.searchsorted(order, np.cumsum([0, *[len(x) // 32 for x in blobs]]))
            parts = [where[order[a:b]] for a, b in zip(edge[:-1], edge[1:])]
            return pa.table({"bucket": pa.array(buckets_of, pa.int32()),
                             "spans": pa.array([np.column_stack([x, x[:, 1] + LENGTH]).tobytes() for x in parts], pa.binary())})
        out: dict[int, list[tuple]] = {}

        def put(e, run, a, b):
            """Windows at the offsets a to b before the start are covered."""
            out.setdefault(buckets_of[run], []).append((e[2], e[3] - b, e[3] - a + LENGTH))

        def close(group):
            if len(group) > 1:
                for k, a, b in windows_shared(group):
                    put(group[k], group[k][5], a, b)

        group: list[tuple] = []
        for e, k, run in merge([read_run(x) for x in blobs]):
            if group and k < PREFIX:
                close(group)
                group = []
            if group and k == len(e[0]) == len(group[-1][0]) and e[1] == group[-1][1]:
                put(e, run, LENGTH - len(e[0]), len(e[1]))
                continue
            # Equal suffixes left out between two of a group share all with the one before them.
            group.append((e[0], e[1], e[2], e[3], k, run))
        close(group)
        return pa.table({"bucket": pa.array(list(out), pa.int32()), "spans": pa.array([np.array(x, np.int64).tobytes() for x in out.values()], pa.binary())})

    sent = docs.groupBy("bucket").cogroup(found.where("bucket >= 0").groupBy("bucket")).applyInArrow(runs, "range int, bucket int, blob binary")
    return sent.groupBy("range").applyInArrow(resolve, "bucket int, spans binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
                   bucket_bytes: int = BUCKET_BYTES, big: int = BIG) -> DataFrame:
    """``id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (the remaining bytes) for every row, or
    with ``digest`` the SHA-256 of these instead (``kept_sha256``)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / bucket_bytes))
    docs = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"))
    ranges = min(buckets, RANGES)
    spans = covered(docs, buckets, min(1.0, SAMPLE * ranges * 26 / max(1, size)), ranges, big)

    def cut(key, left, right):
        number, known, nth, text, _ = texts_of(left)
        found = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in right["spans"].to_pylist()]
        found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        out = {"id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        # Places carry the number of the document among those of its id above bit 40.
        low = np.searchsorted(found[:, 0], number, "left")
        for k, t in enumerate(text):
            i, parts, at, spans_of, end = low[k], [], 0, 0, -1
            while i < len(found) and found[i, 0] == number[k] and found[i, 1] < (nth[k] + 1) << 40:
                a, b = found[i, 1:].tolist()
                i += 1
                if a < nth[k] << 40:
                    continue
                a, b = a - (int(nth[k]) << 40), b - (int(nth[k]) << 40)
                if a > end:
                    spans_of += 1
                    parts.append(t[at:a])
                end = max(end, b)
                at = max(at, b)
            kept = b"".join([*parts, t[at:]])
            for name, v in zip(out, (int(number[k]) if known[k] else None, len(t), len(t) - len(kept), spans_of, hashlib.sha256(kept).hexdigest() if digest else kept)):
                out[name].append(v)
        kinds = [pa.int64()] * 4 + [pa.string() if digest else pa.binary()]
        return pa.table({n if n != "kept" or not digest else "kept_sha256": pa.array(v, kind) for (n, v), kind in zip(out.items(), kinds)})

    last = "kept_sha256 string" if digest else "kept binary"
    return (docs.groupBy("bucket").cogroup(spans.groupBy("bucket"))
            .applyInArrow(cut, f"id long, n_bytes long, n_removed long, n_spans long, {last}"))
