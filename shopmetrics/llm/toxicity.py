"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in its words and word
beginnings (hashed); a document's score is the noisy-or of its sentences, 1 - prod(1 - p).  The
weights are learned from document labels alone, by the gradient of the log loss through the
noisy-or, and the same sentence probabilities then tell which sentences offend.

Learning takes a sample of labelled rows bounded by ``PER_CLASS`` for each label (chosen by a hash of the id,
from whole texts); features of fewer than ``LEAST_DOCS`` of these documents, or
not clearly (``LEAST_Z``) more frequent in toxic ones, are left out.  Texts are scored
whole, where they lie, with no shuffle.

Cases: a null, empty or wordless text has score 0; with no labelled rows, or rows of one label only, every
score is 0; a document labelled twice with both labels counts as toxic; repeated rows get the same
answer; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm.common import append_columns, pieces, utf8
from shopmetrics.llm.decontaminate import multipliers, words_of
from shopmetrics.llm.langid import held_out

#: Training rows of each label, at most (about; hard limit twice as many).
PER_CLASS, LEAST_DOCS, LEAST_Z = 2000, 3, 4.0
#: Hashed features, lengths of word beginnings in bytes, and bytes of text at a time.
DIMS, BEGINNINGS, PIECE_BYTES = 1 << 18, (4, 5), 2 << 20
THRESHOLD, OFFENDS = 0.3, 0.5

_STOP = np.isin(np.arange(256), [10, 13, 33, 46, 59, 63])


def features(data: np.ndarray, at: np.ndarray, factor: np.ndarray):
    """Hashed features (words x 3), the sentence of each word (with words, numbered from 0), the document
    of each sentence, and the first and last byte of each sentence."""
    low, start, end, whole = words_of(data, at, factor)
    if not len(start):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(BEGINNINGS)), np.int64), none, none, none, none
    columns = [whole]
    for n in BEGINNINGS:
        part = np.zeros(len(start), np.uint64)
        for k in range(n):
            there = start + k < end
            part[there] += (low[start[there] + k].astype(np.uint64) + np.uint64(1)) * factor[k]
        columns.append(part ^ np.uint64(n))
    mixed = [(c * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18) for c in columns]
    doc = np.searchsorted(at, start, "right") - 1
    stop = np.searchsorted(np.flatnonzero(_STOP[data]), start)
    new = np.ones(len(start), bool)
    new[1:] = (stop[1:] != stop[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return np.stack(mixed, 1).astype(np.int64), np.cumsum(new) - 1, doc[first], start[first], end[last]


def train(idx: np.ndarray, sentence: np.ndarray, doc: np.ndarray, y: np.ndarray, prior: float, steps: int = 150) -> dict:
    """Adam on the log loss of the noisy-or; ``y`` by document, ``prior`` the share of toxic ones among all labelled."""
    n, n1 = len(y), int(y.sum())
    by_doc = np.unique((doc[sentence].astype(np.uint32)[:, None] * np.uint32(DIMS) + idx.astype(np.uint32)).ravel())
    toxic = y[by_doc // DIMS] == 1
    in_1, in_0 = (np.bincount(by_doc[x] % DIMS, minlength=DIMS) for x in (toxic, ~toxic))
    rate = (in_1 + in_0) / n
    apart = (in_1 / n1 - in_0 / (n - n1)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / n1 + 1 / (n - n1)))
    used = np.flatnonzero((in_1 + in_0 >= LEAST_DOCS) & (apart >= LEAST_Z))
    del by_doc
    place = np.full(DIMS, len(used), np.int32)
    place[used] = np.arange(len(used))
    code = place[idx]
    some = (code < len(used)).any(1)
    code, sentence = code[some], sentence[some]
    w, bias = np.zeros(len(used) + 1), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = np.where(y == 1, prior / n1, (1 - prior) / (n - n1))
    for k in range(1, steps + 1):
        s = np.bincount(sentence, w[code].sum(1), minlength=len(doc)) + bias
        p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        total = np.bincount(doc, np.logaddexp(0, s), minlength=n)  # -log prod(1 - p)
        # d loss / d total: 1 for clean documents, -(1 - q) / q for toxic ones, q the score.
        slope = share * np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 30)), 1e-6), 1.0)
        g_s = slope[doc] * p
        g = np.bincount(code.ravel(), np.repeat(g_s[sentence], code.shape[1]), minlength=len(w)) + 1e-5 * w
        g[-1], gb = 0, g_s.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-4)
        bias -= 0.1 * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-4)
    out = np.zeros(DIMS, np.float32)
    out[used] = w[:-1]
    return {"w": out, "bias": float(bias)}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          use: Column | None = None, per_class: int = PER_CLASS) -> dict | None:
    """A model from labelled rows where ``use`` (of the id column) holds; default: rows not held out."""
    use = ~held_out(id_col, 4, 2) if use is None else use
    marks = (labels.where(use & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
             .groupBy(id_col).agg(F.max(label_col).cast("int").alias("y")))
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30))
    pick = F.lit(False)
    for y, size in sizes.items():
        pick = pick | ((F.col("y") == y) & (draw < min(1 << 30, int((1 << 30) * per_class / size) + 1)))
    # The sample has 2 * per_class rows a label at most, so it is broadcast and the texts stay where they lie.
    marks = F.broadcast(marks.where(pick).limit(2 * per_class * len(sizes)))
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(marks, id_col).select("text", "y")

    def run(batches):
        factor = multipliers()
        for b in batches:
            data, at = utf8(pc.utf8_lower(b.column(0).cast(pa.large_string())))
            for i, j in pieces(at, PIECE_BYTES):
                idx, sentence, doc, _, _ = features(data[at[i]: at[j]], at[i: j + 1] - at[i], factor)
                word_doc = doc[sentence]
                cut = np.searchsorted(word_doc, np.arange(j - i + 1))
                sent = [sentence[a:e] - (sentence[a] if e > a else 0) for a, e in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([idx[a:e].astype(np.int32).tobytes() for a, e in zip(cut[:-1], cut[1:])], pa.binary()),
                     pa.array([x.astype(np.int32).tobytes() for x in sent], pa.binary()), b.column(1).slice(i, j - i)],
                    names=["idx", "sent", "y"])

    got = rows.mapInArrow(run, "idx binary, sent binary, y int").limit(2 * per_class * len(sizes)).collect()
    got = sorted(((r["y"], bytes(r["idx"]), bytes(r["sent"])) for r in got))  # not by the order in which rows came
    if len({y for y, _, _ in got}) < 2:
        return None
    idx, sentence, doc, n = [], [], [], 0
    for d, (_, a, b) in enumerate(got):
        s = np.frombuffer(b, np.int32)
        if len(s):
            idx.append(np.frombuffer(a, np.int32).reshape(len(s), -1))
            sentence.append(s + np.int32(n))
            doc += [d] * (int(s[-1]) + 1)
            n += int(s[-1]) + 1
    if not idx:
        return None
    return train(np.concatenate(idx), np.concatenate(sentence), np.array(doc), np.array([y for y, _, _ in got]),
                 sizes[1] / sum(sizes.values()))


def sentence_scores(model: dict, data, at, factor):
    """The probability, document, first and last byte of each sentence."""
    idx, sentence, doc, first, last = features(data, at, factor)
    s = np.bincount(sentence, model["w"][idx].sum(1), minlength=len(doc)) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(s, -30, 30))), doc, first, last


FIELDS = [T.StructField("score", T.DoubleType()),
          T.StructField("offending", T.ArrayType(T.StringType()))]


def score(docs: DataFrame, model: dict | None, text_col: str = "text", offends: float = OFFENDS, prefix: str = "") -> DataFrame:
    """``docs`` with the noisy-or score and the offending sentences (those of probability ``offends`` or
    more, as they stand in the lower-cased text); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DIMS floats
    where = docs.columns.index(text_col)

    def of_task():
        own, factor = shared.value, multipliers()

        def of_batch(batch):
            data, at = utf8(pc.utf8_lower(batch.column(where).cast(pa.large_string())))
            n = len(at) - 1
            out, bad = np.zeros(n), [[] for _ in range(n)]
            for i, j in pieces(at, PIECE_BYTES) if own is not None else []:
                part = data[at[i]: at[j]]
                p, doc, first, last = sentence_scores(own, part, at[i: j + 1] - at[i], factor)
                out[i:j] = -np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=j - i))
                for k in np.flatnonzero(p >= offends):
                    bad[i + doc[k]].append(part[first[k]: last[k]].tobytes().decode("utf-8", "replace"))
            return [pa.array(out), pa.array(bad, pa.list_(pa.string()))]

        return of_batch

    return append_columns(docs, [T.StructField(prefix + f.name, f.dataType) for f in FIELDS], of_task)
