"""Figures from Parquet footers alone (E1, E2, E4, IO7): no row group is read.

Row counts, NULL counts and the least and greatest date or number of a column stand in the footers' statistics.  Spark's
second Parquet reader answers aggregates without a filter from them (``PushedAggregation`` in the plan); it and the
push-down are switched on in a session of their own, so other queries keep their reader.  MIN and MAX work
for whole numbers, doubles, booleans and dates; files written without statistics make the query fail with Spark's message.
"""

from __future__ import annotations

from collections.abc import Mapping
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.functions.exprs import round_n

_SESSIONS: WeakKeyDictionary[SparkSession, SparkSession] = WeakKeyDictionary()


def footer_session(spark: SparkSession) -> SparkSession:
    """A session over the same context whose Parquet reads answer aggregates from footers."""
    if spark not in _SESSIONS:
        s = spark.newSession()
        first = [k for k in spark.conf.get("spark.sql.sources.useV1SourceList").split(",") if k != "parquet"]
        s.conf.set("spark.sql.sources.useV1SourceList", ",".join(first))
        s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        s.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
        _SESSIONS[spark] = s
    return _SESSIONS[spark]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def row_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Table, rows, columns of the Parquet tables at ``paths``."""
    s = footer_session(spark)
    read = {name: s.read.parquet(path) for name, path in paths.items()}
    # The pushed count of a table without row groups is NULL, though Spark takes a count for non-null (coalesce would be dropped).
    return _union([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), F.greatest("rows", F.lit(0)).cast("long").alias("rows"),
                                                                  F.lit(len(df.columns)).alias("columns"))
                   for name, df in read.items()])


def null_counts(spark: SparkSession, paths: Mapping[str, str], only_with_nulls: bool = True) -> DataFrame:
    """Table, column, nulls, pct, from COUNT(column) in the footers."""
    s, parts = footer_session(spark), []
    for name, path in paths.items():
        df = s.read.parquet(path)
        wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"`{c}`").alias(f"_n{i}") for i, c in enumerate(df.columns)])
        args = ", ".join(f"'{c}', greatest(_rows, 0) - greatest(_n{i}, 0)" for i, c in enumerate(df.columns))
        parts.append(wide.selectExpr(f"'{name}' as table", "_rows as rows", f"stack({len(df.columns)}, {args}) as (`column`, nulls)"))
    u = _union(parts)
    u = u.where("nulls > 0") if only_with_nulls else u
    share = F.col("nulls").cast("double") / F.nullif(F.col("rows").cast("double"), F.lit(0.0)) * F.lit(100.0)
    return u.select("table", "column", "nulls", round_n(share, 1).alias("pct"))


def ranges(spark: SparkSession, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Table, column, min_date, max_date (text); ``columns``: the path and a column for each table."""
    s = footer_session(spark)
    return _union([
        s.read.parquet(path).agg(F.min(c).alias("a"), F.max(c).alias("b")).select(
            F.lit(name).alias("table"), F.lit(c).alias("column"), F.col("a").cast("string").alias("min_date"), F.col("b").cast("string").alias("max_date"))
        for name, (path, c) in columns.items()])
