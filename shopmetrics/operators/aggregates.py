"""Generic aggregate operators: shares of a total, top-k, value counts, equal-width histograms.

All are compositions of built-in DataFrame operations.  Global windows appear only over
already aggregated (small, key-bounded) frames, never over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.functions.exprs import col, round_n



def share_of_total(part: str | Column, n: int | None = 2) -> Column:
    """``100 * part / SUM(part) OVER ()`` on an aggregated frame."""
    p = col(part).cast("double")
    total = F.sum(col(part)).over(Window.partitionBy()).cast("double")
    v = F.lit(100.0) * p / F.nullif(total, F.lit(0.0))
    return v if n is None else round_n(v, n)


def ordered(*cols):
    """Total order for a small, key-bounded result (per month, stage, channel, cohort...):
    ``df.transform(ordered(...))`` moves it to one partition and sorts it in place, which
    avoids the sampling job and extra stage of a range-partitioned ``orderBy``.  Not for
    results that grow with the data."""
    return lambda df: df.repartition(1).sortWithinPartitions(*cols)


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """``ORDER BY ... LIMIT k``; the caller ends ``order`` with a unique key so ties are
    broken the same way every run.  Planned as TakeOrderedAndProject: each partition keeps
    its own k best rows, no full sort."""
    return df.orderBy(*order).limit(k)


def value_counts(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """``groupBy(key).count()`` with a named count column."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def equal_width_histogram(df: DataFrame, value: str, bins: int, mean: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] of the column ``value`` with the last bin right-closed.

    One scan: rows are counted by exact value first (cents, prices: map-side, so a value that a third of the rows has is one
    row a task), and everything else comes from these counts.  The range is a scalar subquery over them, which shares
    their exchange with the binning; nothing runs while the query is built.  A ``bins``-row frame supplies
    the empty bins.  A degenerate range (min == max) is widened to [min-0.5, max+0.5].
    Columns: bin (0-based), lo, hi, count, then with ``mean`` a column of that name, the exact mean to 2 places.
    """
    counts = df.select(col(value).alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    exact = F.sum(F.col("v") * F.col("n")).cast("double") / F.nullif(F.sum("n"), F.lit(0)).cast("double")
    stats = counts.agg(F.struct(F.min("v").cast("double").alias("mn"), F.max("v").cast("double").alias("mx"),
                                round_n(exact, 2).alias("mean")).alias("s")).scalar()
    mn, mx = stats.getField("mn"), stats.getField("mx")
    lo0 = F.when(mn == mx, mn - 0.5).otherwise(mn)
    hi0 = F.when(mn == mx, mx + 0.5).otherwise(mx)
    width = (hi0 - lo0) / F.lit(float(bins))
    # Bin index as numpy computes it: scaled offset, clamped, then nudged by one so that
    # every value lies within the edges of its bin (edges = lo + i * width).
    norm = F.lit(float(bins)) / (hi0 - lo0)
    b0 = F.least(F.floor((F.col("v") - F.col("lo0")) * F.col("norm")), F.lit(bins - 1)).cast("int")
    b1 = F.when(F.col("v") < F.col("lo0") + F.col("b0") * F.col("width"), F.col("b0") - 1).otherwise(F.col("b0"))
    b2 = F.when((F.col("v") >= F.col("lo0") + (F.col("b1") + 1) * F.col("width")) & (F.col("b1") != bins - 1), F.col("b1") + 1) \
        .otherwise(F.col("b1"))
    binned = counts.select(F.col("v").cast("double").alias("v"), "n", lo0.alias("lo0"), norm.alias("norm"), width.alias("width")) \
        .withColumn("b0", b0).withColumn("b1", b1).select(b2.alias("bin"), "n").groupBy("bin").agg(F.sum("n").alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), lo0.alias("lo0"), hi0.alias("hi0"), width.alias("width"))
    edges = frame.select(
        "bin",
        (F.col("lo0") + F.col("bin") * F.col("width")).alias("lo"),
        F.when(F.col("bin") == bins - 1, F.col("hi0")).otherwise(F.col("lo0") + (F.col("bin") + 1) * F.col("width")).alias("hi"),
    )
    extra = [stats.getField("mean").alias(mean)] if mean else []
    return edges.join(binned, "bin", "left").select(
        "bin", "lo", "hi", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"), *extra)
