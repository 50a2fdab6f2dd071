"""Canonical tables stored by month (IO2): reads of a span of days touch the folders of its months only.

The partition column ``month_key`` (``yyyy-MM``) is derived from the table's date when it is written; a span of days is
translated to it when it is read, beside the predicate on the date itself, which goes on to the row groups.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.functions.exprs import month_key
from shopmetrics.model import SCHEMAS

#: The date of each table that has one.
DATE_OF = {"sessions": "session_date", "events": "ts", "orders": "order_date"}
KEY = "month_key"


def write_monthly(df: DataFrame, table: str, path: str, mode: str = "overwrite") -> None:
    """Store ``df`` by month of its date; rows of a month are gathered (a large month is split over tasks), rows without a
    date lie in a folder of their own."""
    names = SCHEMAS[table].names
    df.select(*names, month_key(DATE_OF[table]).alias(KEY)).hint("rebalance", KEY).write.mode(mode).partitionBy(KEY).parquet(path)


def within(table: str, first: str | dt.date | None, last: str | dt.date | None) -> Column:
    """Rows whose date lies between both days (included), with the same bounds on the month."""
    day, out = F.to_date(DATE_OF[table]), F.lit(True)
    if first is not None:
        out &= (day >= F.lit(str(first)).cast("date")) & (F.col(KEY) >= F.lit(str(first)[:7]))
    if last is not None:
        out &= (day <= F.lit(str(last)).cast("date")) & (F.col(KEY) <= F.lit(str(last)[:7]))
    return out


def read_span(spark: SparkSession, table: str, path: str, first: str | dt.date | None = None, last: str | dt.date | None = None) -> DataFrame:
    """The rows of ``table`` from ``first`` to ``last`` (None: open; without both, also rows without a date)."""
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in SCHEMAS[table]], T.StructField(KEY, T.StringType())])
    return spark.read.schema(schema).parquet(path).where(within(table, first, last)).select(*SCHEMAS[table].names)
