"""Quality rules with the perplexity of an n-gram model.

Base rules look at one text alone: too few words, or too many words in windows of eight words that the text repeats.
Texts that pass are judged by an interpolated modified Kneser-Ney model of order ``ORDER`` and by bands of
their language: a perplexity above the upper bound is noise, one below the lower bound is boilerplate.

Symbols.  The model reads the words of a text as they stand, one space between them: every UTF-8 byte is a symbol of its own
(``BYTES``; runs of white space are one space, and none at the start), with ``ORDER`` - 1 start symbols before it.  Upper and lower case, digits, signs
and the letters of every script are told apart.  An n-gram of four symbols is a 32-bit number.  The model grows with
the kinds of n-grams, not with the corpus, and takes 12 bytes for each; it is collected and broadcast.  ``FOLDED`` is a coarser
alphabet of 62 classes for callers of ``measure``; ``judge`` doesn't use it.

Counting.  Every task counts the n-grams of its whole texts and Spark adds the counts up (one row for each n-gram
and task is shuffled).  No text is scored by a model that has seen it: texts are dealt to two
halves by a hash of the text, so that copies fall together, and each half is scored by the model of
the other; without that, a text of rare n-grams would predict itself.

Model.  Lower orders use continuation counts.  Each order has three discounts from its counts of counts (the usual fixed
ones where those can't be had), and is interpolated with the next lower one, the lowest with the uniform
distribution.  Every order is a sorted array of hashes (the packed n-grams) with the probabilities beside it, and one of
contexts with the back-off weights; an n-gram is found by binary search, a missing one by backing off.

Bands.  For each language (as labelled; null is one too) the median and the median absolute deviation of the log
perplexity come from a histogram in steps of 1/1000 over all texts that pass the base rules; the band is the median
+- ``WIDTH`` deviations, at least ``LEAST`` nats.  Short texts scatter more, with the root of their length: the same figure of
sqrt(m) times the distance from the median, m symbols in a text, is the deviation of one symbol, and the deviation of
a text is taken to be at least that over sqrt(m).

Cases: a null, empty or blank text has no words, fails the base rules and has no perplexity; repeated rows count
each; copies of a text get equal figures; ids may be null; a corpus without texts in one half scores by the
uniform distribution there; an empty table gives no rows.  A text lies in one task whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm.common import append_columns, free_name, materialize, pieces, salted_join, utf8

ORDER, BITS = 4, 6
#: Words of a window looked for again in the same text, fewest words, and the percentage of words in repeated windows allowed.
WINDOW, LEAST_WORDS, REPEATED = 8, 20, 30
#: Half-width of a band: deviations, and nats at least.
WIDTH, LEAST = 6.0, 0.05
#: Steps of the histogram in a nat, and bytes of text looked at together.
STEPS, PIECE = 1000, 4 << 20

SPACE, START = 1, 0
_SEPARATOR = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_SYMBOL = np.array([chr(c) in "#*$%&|<>" for c in range(256)])
FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def class_of(byte: int) -> int:
    """The symbol of a byte: 1 space, 2-27 letters, 28 digits, 29-36 other printing ASCII, 37 control bytes, 38-45
    first bytes and 46-61 later bytes of a longer code."""
    c = chr(byte).lower() if byte < 128 else ""
    if _SEPARATOR[byte]:
        return SPACE
    if "a" <= c <= "z":
        return 2 + ord(c) - 97
    if "0" <= c <= "9":
        return 28
    if byte < 128:
        return 29 + byte % 8 if 32 < byte < 127 else 37
    return 38 + byte % 8 if byte >= 192 else 46 + byte % 16


CLASSES = np.array([class_of(b) for b in range(256)], np.uint8)
#: Number of symbols that can follow (all but the start).
VOCABULARY = 61


@dataclass(frozen=True, eq=False)
class Alphabet:
    """The symbol of each byte (0 is the start, ``space`` any white space), the bits of a symbol, and how many can follow."""

    code: np.ndarray
    space: int
    bits: int
    size: int


FOLDED = Alphabet(CLASSES, SPACE, BITS, VOCABULARY)
#: Each byte is its own symbol; white space is 32, and byte 0 takes the place of the tab, which that leaves free.
BYTES = Alphabet(np.array([32 if _SEPARATOR[b] else b or 9 for b in range(256)], np.uint8), 32, 8, 251)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def figures(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``FIGURES`` of each text, a row each.  ``data``: the bytes one text after the other, ``at`` their offsets."""
    n = len(at) - 1
    size = np.diff(at)
    doc = np.repeat(np.arange(n), size)
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
    start = np.flatnonzero(first)
    of = doc[start]
    points = inside & ((data & 0xC0) != 0x80)
    out = np.zeros((len(FIGURES), n), np.int64)
    out[0] = np.bincount(of, minlength=n)
    out[1] = np.bincount(doc[points], minlength=n)
    out[2] = np.bincount(doc[_SYMBOL[data]], minlength=n)
    raw = data.tobytes()
    for k in range(n):
        lines = [x for x in raw[at[k]: at[k + 1]].split(b"\n") if x.strip()]
        out[3, k] = len(lines) - len(set(lines))
    if len(start) >= WINDOW:
        # Word hashes: each byte times a factor of its place in the word; window hashes from eight of them.
        where = np.flatnonzero(inside)
        word = np.cumsum(first)[where] - 1
        place = where - start[word]
        factor = mixed(np.arange(1, int(place.max()) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        begin = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        h = mixed(np.add.reduceat((data[where].astype(np.uint64) + np.uint64(1)) * factor[place], begin))
        m = len(h) - WINDOW + 1
        key = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            key = mixed(key + h[k: k + m])
        here = np.flatnonzero(of[:m] == of[WINDOW - 1:])
        key = key[here] ^ mixed(of[here].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(here), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, here[again], 1)
        np.add.at(edge, here[again] + WINDOW, -1)
        out[4] = np.bincount(of[np.cumsum(edge)[:-1] > 0], minlength=n)
    return out


def grams(data: np.ndarray, at: np.ndarray, alphabet: Alphabet = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-gram that ends at each symbol of each text, and the number of the text."""
    size = np.diff(at)
    doc = np.repeat(np.arange(len(size)), size)
    symbol = alphabet.code[data]
    space = symbol == alphabet.space
    keep = ~space
    keep[1:] |= ~space[:-1] & (doc[1:] == doc[:-1])
    symbol, doc = symbol[keep], doc[keep]
    if not len(doc):
        return np.zeros(0, np.uint32), doc
    pad = ORDER - 1
    s = np.full(len(doc) + pad * len(size), START, np.uint32)
    to = np.arange(len(doc)) + pad * (doc + 1)
    s[to] = symbol
    key = s.copy()
    for k in range(1, ORDER):
        key[k:] |= s[:-k] << np.uint32(alphabet.bits * k)
    return key[to], doc


def counts(texts: DataFrame, text_col: str, half_col: str, alphabet: Alphabet = FOLDED) -> DataFrame:
    """``half``, ``gram``, ``n``: how often each n-gram occurs in the texts of each half."""
    def run(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            data, at = utf8(b.column(0))
            half = np.asarray(b.column(1))
            for i, j in pieces(at, PIECE):
                key, doc = grams(data[at[i]: at[j]], at[i: j + 1] - at[i], alphabet)
                for k in (0, 1):
                    own, n = np.unique(key[half[i:j][doc] == k], return_counts=True)
                    if k in total:
                        keys, back = np.unique(np.concatenate([total[k][0], own]), return_inverse=True)
                        own, n = keys, np.bincount(back, np.concatenate([total[k][1], n])).astype(np.int64)
                    total[k] = own, n
        for k, (key, n) in total.items():
            for i in range(0, len(key), 1 << 16):
                part = key[i: i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(part.astype(np.int64)),
                                                  pa.array(n[i: i + (1 << 16)])], names=["half", "gram", "n"])

    each = texts.select(text_col, half_col).mapInArrow(run, "half int, gram long, n long")
    return each.groupBy("half", "gram").agg(F.sum("n").alias("n"))


def discounts(n: np.ndarray) -> np.ndarray:
    """What is taken off a count of 0, 1, 2, and 3 or more."""
    c = [int((n == k).sum()) for k in range(1, 5)]
    if not all(c):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = c[0] / (c[0] + 2 * c[1])
    d = np.array([0.0] + [k - (k + 1) * y * c[k] / c[k - 1] for k in (1, 2, 3)])
    return np.clip(d, [0, 0.01, 0.01, 0.01], [0, 0.99, 1.99, 2.99])


class Model:
    """Sorted arrays of packed n-grams with log probabilities, and of contexts with log back-off weights, for each order."""

    def __init__(self, key: np.ndarray, n: np.ndarray, alphabet: Alphabet = FOLDED):
        """``key``: the n-grams of the highest order, sorted; ``n``: their counts."""
        self.bits, self.size = alphabet.bits, alphabet.size
        levels = [(key.astype(np.uint32), n.astype(np.int64))]
        for order in range(ORDER - 1, 0, -1):  # continuation counts: different symbols before
            levels.append(tuple(np.unique(self.suffix(levels[-1][0], order), return_counts=True)))
        self.grams, self.logp, self.contexts, self.weight = [], [], [], []
        for order, (key, n) in enumerate(reversed(levels), 1):
            d = discounts(n)
            context, of = np.unique(key >> np.uint32(self.bits), return_inverse=True)
            total = np.bincount(of, n, len(context))
            off = np.bincount(of, d[np.minimum(n, 3)], len(context))
            if order == 1:
                lower = np.full(len(key), 1 / self.size)
            else:
                lower = np.exp(self.log_probability(self.suffix(key, order - 1), order - 1))
            p = (n - d[np.minimum(n, 3)]) / total[of] + off[of] / total[of] * lower
            self.grams.append(key)
            self.logp.append(np.log(p))
            self.contexts.append(context)
            self.weight.append(np.log(off / total))

    def suffix(self, key: np.ndarray, order: int) -> np.ndarray:
        """The last ``order`` symbols of packed n-grams."""
        return key & np.uint32((1 << self.bits * order) - 1)

    @staticmethod
    def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return i, keys[i] == x

    def log_probability(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """The log probability of the last symbol of each packed n-gram after the others."""
        if order == 0:
            return np.full(len(key), -np.log(self.size))
        key = key.astype(np.uint32)
        i, there = self.find(self.grams[order - 1], key)
        out = np.zeros(len(key))
        out[there] = self.logp[order - 1][i[there]]
        rest = key[~there]
        if len(rest):
            i, known = self.find(self.contexts[order - 1], rest >> np.uint32(self.bits))
            back = np.zeros(len(rest))
            back[known] = self.weight[order - 1][i[known]]
            out[~there] = back + self.log_probability(self.suffix(rest, order - 1), order - 1)
        return out


def learn(texts: DataFrame, text_col: str, half_col: str, alphabet: Alphabet = FOLDED) -> list[Model]:
    """The model of each half: one count for each kind of n-gram in it comes to the driver, and is sorted by n-gram."""
    found = materialize(counts(texts, text_col, half_col, alphabet)).toArrow()
    half, key, n = (found.column(k).to_numpy() for k in ("half", "gram", "n"))
    out = []
    for k in (0, 1):
        own = np.flatnonzero(half == k)
        own = own[np.argsort(key[own], kind="stable")]
        out.append(Model(key[own], n[own], alphabet))
    return out


def measure(docs: DataFrame, text_col: str = "text", alphabet: Alphabet = FOLDED) -> DataFrame:
    """``docs`` with ``FIGURES``, ``n_symbols_read`` (symbols the model reads) and ``log_perplexity`` (null without symbols)."""
    half = free_name(docs, "half")
    dealt = docs.withColumn(half, F.pmod(F.xxhash64(text_col), F.lit(2)).cast("int"))
    models = docs.sparkSession.sparkContext.broadcast(learn(dealt, text_col, half, alphabet))
    text_at, half_at = docs.columns.index(text_col), len(docs.columns)
    fields = [T.StructField(k, T.LongType()) for k in [*FIGURES, "n_symbols_read"]] + [T.StructField("log_perplexity", T.DoubleType())]

    def make():
        own = models.value

        def of(b):
            data, at = utf8(b.column(text_at))
            halves = np.asarray(b.column(half_at))
            figure, read, loss = [], [], []
            for i, j in pieces(at, PIECE):
                part, offsets = data[at[i]: at[j]], at[i: j + 1] - at[i]
                figure.append(figures(part, offsets))
                key, doc = grams(part, offsets, alphabet)
                logp = np.zeros(len(key))
                for k in (0, 1):
                    here = np.flatnonzero(halves[i:j][doc] == k)
                    logp[here] = own[1 - k].log_probability(key[here])
                read.append(np.bincount(doc, minlength=j - i))
                loss.append(-np.bincount(doc, logp, j - i))
            if not figure:
                return [pa.array([], f.dataType.simpleString() == "double" and pa.float64() or pa.int64()) for f in fields]
            m = np.concatenate(read)
            mean = np.concatenate(loss) / np.maximum(m, 1)
            return [*[pa.array(x) for x in np.concatenate(figure, axis=1)], pa.array(m), pa.array(mean, mask=m == 0)]

        return of

    return append_columns(dealt, fields, make).drop(half)


def bands(measured: DataFrame, lang_col: str, passed: str) -> DataFrame:
    """``lang_col``, ``middle``, ``deviation``, ``symbol``: median and median absolute deviation of the log perplexity of each
    language, and the deviation of one symbol."""
    step = F.round(F.col("log_perplexity") * STEPS).cast("long")
    seen = (measured.where(F.col(passed) & F.col("log_perplexity").isNotNull())
            .groupBy(lang_col, step.alias("x"), F.ceil(F.sqrt("n_symbols_read")).alias("root")).agg(F.count(F.lit(1)).alias("n")))

    def median(x: DataFrame, name: str) -> DataFrame:
        by = Window.partitionBy(lang_col)
        upto = F.sum("n").over(by.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hist = x.groupBy(lang_col, "x").agg(F.sum("n").alias("n"))
        half = hist.withColumn("upto", upto).withColumn("total", F.sum("n").over(by)).where(F.col("upto") * 2 >= F.col("total"))
        return half.groupBy(lang_col).agg((F.min("x") / STEPS).alias(name))

    middle = median(seen, "middle")
    off = seen.join(middle, lang_col).select(lang_col, "n", "root", F.abs(F.col("x") - F.round(F.col("middle") * STEPS).cast("long")).alias("x"))
    both = middle.join(median(off, "deviation"), lang_col).join(median(off.withColumn("x", F.col("x") * F.col("root")), "symbol"), lang_col)
    return both.select(lang_col, "middle", (F.col("deviation") * 1.4826).alias("deviation"), (F.col("symbol") * 1.4826).alias("symbol"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = WIDTH,
          least: float = LEAST) -> DataFrame:
    """``id``, ``lang``, ``FIGURES``, ``base_failed``, ``perplexity``, ``lower`` and ``upper`` (the band for this text) and ``kept``."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    measured = measure(own, alphabet=BYTES).drop("text")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    # A null language is a language of its own.
    named = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    measured = materialize(measured.withColumn("base_failed", failed).withColumn("passed", ~failed).withColumn("lang_key", named))
    band = bands(measured, "lang_key", "passed")
    spread = F.greatest(F.col("deviation"), F.col("symbol") / F.sqrt(F.greatest(F.col("n_symbols_read"), F.lit(1))))
    half = F.greatest(F.lit(width) * spread, F.lit(least))
    within = F.col("log_perplexity").between(F.col("middle") - half, F.col("middle") + half)
    both = salted_join(measured, band, ["lang_key"], ["id", "log_perplexity"], "left")
    return both.select("id", "lang", *FIGURES, "base_failed", F.exp("log_perplexity").alias("perplexity"),
                       F.exp(F.col("middle") - half).alias("lower"), F.exp(F.col("middle") + half).alias("upper"),
                       (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))
