"""Language identification with error-correcting output codes.

Each language gets a codeword; one binary classifier over hashed byte n-grams predicts each bit of it.
A text's language is the codeword with the least loss, the logistic loss of each bit weighted by how
well its classifier separates the training rows; a text whose two best codewords are near each
other is flagged as ambiguous.

Learning takes a sample of labelled rows bounded by ``PER_CLASS`` for each language (chosen by a hash of the id);
rows are labelled if ``lang`` is not null and they are not held out.  Texts are scored whole, where they
lie, with no shuffle.

Cases: a null text or one without a letter is ``und`` with score 0; if nothing could be learned every
text is ``und``; with one language every text with a letter is of it; repeated rows get the same answer;
an empty table gives an empty result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm.common import append_columns, pieces, utf8

#: Training rows of each language, at most (about; hard limit twice as many), and of all: with many languages each has
#: fewer.  A row takes 8 KB at the driver, so the sample stays near 100 MB however many languages there are.
PER_CLASS, SAMPLE = 800, 12_800
#: Hashed n-grams of 1 to 4 bytes; bytes and texts counted at a time.
DIMS, GRAMS, PIECE_BYTES, PIECE_ROWS = 1 << 12, 4, 2 << 20, 512
#: Margin of the weighted loss under which a text counts as ambiguous.
MARGIN = 0.25
UNDETERMINED = "und"

_LETTER = np.array([32 if c < 128 and not (97 <= c <= 122) else c for c in range(256)], np.uint8)


def gram_counts(column: pa.Array, i: int, j: int) -> np.ndarray:
    """A row of hashed n-gram counts, square-rooted and scaled to length 1, for texts i to j."""
    data, at = utf8(pc.utf8_lower(column.slice(i, j - i)))
    code, n = _LETTER[data].astype(np.uint32), len(at) - 1
    counts = np.zeros(n * DIMS, np.float32)
    doc = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(at))
    gram = np.zeros(len(code), np.uint32)
    for k in range(GRAMS):
        if k >= len(code):
            break
        gram = gram[: len(code) - k] * np.uint32(0x01000193) + code[k:] + np.uint32(1)
        good = doc[: len(gram)] == doc[k:]
        mixed = (gram ^ np.uint32(k * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        counts += np.bincount((doc[: len(gram)] + (mixed >> np.uint32(20)))[good], minlength=n * DIMS)
    x = np.sqrt(counts.reshape(n, DIMS))
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def codewords(classes: int) -> np.ndarray:
    """A +-1 row for each class: all splits of up to 6 classes, else splits drawn by a fixed rule until
    every pair of classes differs in a quarter of the bits at least."""
    if classes <= 6:
        bits = [[1 if c == 0 or s >> (c - 1) & 1 else -1 for s in range(2 ** (classes - 1) - 1)] for c in range(classes)]
        return np.array(bits, np.float32).reshape(classes, -1)
    rng, n = np.random.default_rng(classes), 4 * int(np.ceil(np.log2(classes))) + 15
    half = np.where(np.arange(classes) % 2, 1, -1)
    for _ in range(1000):
        code = np.stack([rng.permutation(half) for _ in range(n)], 1).astype(np.float32)
        apart = n - (code @ code.T + n) / 2 + n * np.eye(classes)
        if apart.min() >= n / 4:
            break
    return code


def train(x: np.ndarray, y: np.ndarray, names: list[str], steps: int = 150, decay: float = 1e-5) -> dict:
    """Logistic regression of every bit at once, by Nesterov's gradient steps."""
    code = codewords(len(names))
    target = code[y]
    if not code.shape[1]:
        return {"names": names, "code": code, "w": np.zeros((DIMS + 1, 0), np.float32), "weight": np.zeros(0, np.float32)}
    # Every language counts the same, whatever its share of the sample.
    share = (1 / np.bincount(y, minlength=len(names))[y] / len(names)).astype(np.float32)[:, None]
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = v = np.zeros((x.shape[1], code.shape[1]), np.float32)
    for k in range(steps):
        ahead = w + k / (k + 3) * (w - v)
        slope = -target * share / (1 + np.exp(np.clip(target * (x @ ahead), -30, 30)))
        v, w = w, ahead - 2.0 * (x.T @ slope + decay * ahead)
    gain = ((np.sign(x @ w) == target) * share).sum(0)
    return {"names": names, "code": code, "w": w.astype(np.float32), "weight": np.maximum(2 * gain - 1, 0.01).astype(np.float32)}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class numbers, scores (share of the best codeword) and whether two codewords are near."""
    code, weight = model["code"], model["weight"]
    if len(code) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x)), np.zeros(len(x), bool)
    m = x @ model["w"][:-1] + model["w"][-1]
    loss = np.logaddexp(0, -m) @ (weight * (code > 0)).T + np.logaddexp(0, m) @ (weight * (code < 0)).T
    loss = loss / weight.sum()
    best = loss.argmin(1)
    ranked = np.sort(loss, 1)
    part = np.exp((ranked[:, :1] - loss) * code.shape[1])
    return best, (1 / part.sum(1)).astype(np.float64), ranked[:, 1] - ranked[:, 0] < MARGIN


def held_out(id_col: str, of: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` when divided by ``of`` (null id: not)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == rest, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          use: Column | None = None, per_class: int = PER_CLASS) -> dict | None:
    """A model from rows where ``use`` holds (default: the rows that aren't held out)."""
    use = ~held_out(id_col, 5, 0) if use is None else use
    # The id chooses the sample; it is no feature.
    rows = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                       F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1 << 30)).alias("draw"))
    sizes = rows.groupBy("lang").count().collect()  # a row for each label
    if not sizes:
        return None
    if len(sizes) > SAMPLE:
        raise ValueError(f"{len(sizes)} languages are more than the {SAMPLE} rows of the training sample; raise SAMPLE")
    names = sorted(r["lang"] for r in sizes)
    number = {k: i for i, k in enumerate(names)}
    per_class = min(per_class, SAMPLE // len(names))
    most = json.dumps({r["lang"]: min(1 << 30, int((1 << 30) * per_class / r["count"]) + 1) for r in sizes})
    # A literal map, so that the texts are neither joined nor shuffled.
    picked = rows.where(F.col("draw") < F.element_at(F.from_json(F.lit(most), "map<string, bigint>"), F.col("lang")))

    def run(batches):
        for b in batches:
            _, at = utf8(b.column(1))
            for i, j in ranges(at):
                x = gram_counts(b.column(1), i, j).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = picked.select("lang", "text").mapInArrow(run, "lang string, x binary").limit(2 * per_class * len(names)).collect()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    y = np.array([number[r["lang"]] for r in got])
    order = np.lexsort((x @ np.arange(DIMS, dtype=np.float32), y))  # not by the order in which rows came
    return train(x[order], y[order], names)


def ranges(at: np.ndarray) -> list[tuple[int, int]]:
    return [(k, min(k + PIECE_ROWS, j)) for i, j in pieces(at, PIECE_BYTES) for k in range(i, j, PIECE_ROWS)]


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
          T.StructField("ambiguous", T.BooleanType())]


def identify(docs: DataFrame, model: dict | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``FIELDS`` (names after ``prefix``) appended; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DIMS x bits
    where = docs.columns.index(text_col)

    def of_task():
        own = shared.value

        def of_batch(batch):
            column = batch.column(where).cast(pa.large_string())
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = len(column)
            lang, score, near = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
            if own is not None:
                _, at = utf8(column)
                for i, j in ranges(at):
                    lang[i:j], score[i:j], near[i:j] = decode(own, gram_counts(column, i, j))
                names = [own["names"][k] if ok else UNDETERMINED for k, ok in zip(lang, lettered)]
            else:
                names = [UNDETERMINED] * n
            return [pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(near | ~lettered)]

        return of_batch

    return append_columns(docs, [T.StructField(prefix + f.name, f.dataType) for f in FIELDS], of_task)
