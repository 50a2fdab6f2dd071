"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every three lines in a row are hashed (128 bits); a window that occurs again, in the order of (id, text
hash, place), is a later occurrence.  The places of later occurrences are merged to runs of covered
lines for each document, and these lines go.  Windows are judged on the input, and the first
occurrence stays whole unless an earlier window covers some of its lines.

First places come from one aggregation, pre-aggregated map-side; they meet the windows again
in a salted join, so a window that a third of all documents share is spread over tasks.  A document's
own places are gathered for the document alone, and its text is cut by slices of its lines.

Cases: a null text stays null; texts of fewer than three lines, and windows of three blank lines, are left
alone; a document all of whose lines go keeps its row with an empty text; rows with the same
id and text count as one document; ids may be null (they come first); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.llm.common import free_name, salted_join

WINDOW = 3
#: Characters of which a blank line may consist.
BLANK = " \t\r\f\x0b"


def windows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id``, ``t`` (hash of the text), ``p`` (place from 0), ``h`` and ``g`` (hash) of every window that isn't blank."""
    lines = F.split(F.col(text_col), "\n")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), lines.alias("l")).where(F.size("l") >= size)

    def window(p: Column) -> Column:
        part = [F.get("l", p + k) for k in range(size)]
        return F.struct(p.alias("p"), F.xxhash64(*part).alias("h"), F.xxhash64(F.lit("g"), *part).alias("g"),
                        (F.btrim(F.concat(*part), F.lit(BLANK)) != "").alias("said"))

    each = F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - size), window)).alias("w")
    return rows.select("id", "t", each).select("id", "t", "w.*").where("said").drop("said")


def covered_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``id``, ``t``, ``starts``, ``ends``: the runs of lines (end exclusive) that later occurrences cover, for every
    document that has some."""
    w = windows(docs, id_col, text_col, size)
    first = (w.groupBy("h", "g").agg(F.min(F.struct("id", "t", "p")).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    later = (salted_join(w, first, ["h", "g"], ["id", "t", "p"])
             .where(~F.col("first").eqNullSafe(F.struct("id", "t", "p"))))
    at = later.groupBy("id", "t").agg(F.array_sort(F.collect_set("p")).alias("at"))
    starts = F.filter("at", lambda p, k: (k == 0) | (p - F.get("at", k - 1) > size))
    lasts = F.filter("at", lambda p, k: (k == F.size("at") - 1) | (F.get("at", k + 1) - p > size))
    return at.select("id", "t", starts.alias("starts"), F.transform(lasts, lambda p: p + size).alias("ends"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
                    count: bool = False) -> DataFrame:
    """``docs`` with the covered lines removed from ``text_col``; with ``count`` also ``n_lines``, ``n_removed``
    and ``n_spans`` (runs removed), with underscores where ``docs`` has such a column."""
    names = {k: free_name(docs, f"dedup_{k}") for k in ("id", "t", "starts", "ends", "own")}
    runs = covered_runs(docs, id_col, text_col, size).select(*[F.col(k).alias(names[k]) for k in ("id", "t", "starts", "ends")])
    own, starts, ends = names["own"], names["starts"], names["ends"]
    both = docs.withColumn(own, F.xxhash64(text_col))
    both = both.join(runs, F.col(id_col).eqNullSafe(F.col(names["id"])) & (F.col(own) == F.col(names["t"])), "left")
    lines = F.split(F.col(text_col), "\n")

    def kept(k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
        end = F.when(k == F.size(starts), F.size(lines)).otherwise(F.get(starts, k))
        return F.slice(lines, begin + 1, end - begin)

    rest = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), kept)), "\n")
    more = []
    if count:
        gone = F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a), F.lit(0), lambda x, y: x + y)
        more = [F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(free_name(docs, "n_lines")),
                F.coalesce(gone, F.lit(0)).cast("long").alias(free_name(docs, "n_removed")),
                F.when(F.col(starts).isNull(), 0).otherwise(F.size(starts)).cast("long").alias(free_name(docs, "n_spans"))]
    text = F.when(F.col(starts).isNull(), F.col(text_col)).otherwise(rest).alias(text_col)
    return both.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns], *more)
