"""Funnel and customer counts from one stored table of user bitmaps.

For each (day, device, channel) and mark, a funnel stage or a completed order, the table has the set of users as
bitmaps (``operators/bitmaps.py``).  A new day adds its own rows, from its own events, sessions and orders; every count
is a union of stored sets, whatever days, devices or channels it spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.functions.exprs import period_key
from shopmetrics.model import COMPLETED, STAGES
from shopmetrics.operators.aggregates import ordered
from shopmetrics.operators.bitmaps import bitmaps_of, members
from shopmetrics.operators.funnel_ops import wide_to_long
from shopmetrics.plans import funnel as Fn
from shopmetrics.sources.batches import BatchStore

#: The mark of users with a completed order on a day.
BUYER = "completed order"
GROUP = ["day", "in_session", "device_type", "channel", "mark"]
SCHEMA = T.StructType([T.StructField("day", T.DateType()), T.StructField("in_session", T.BooleanType()), T.StructField("device_type", T.StringType()),
                       T.StructField("channel", T.StringType()), T.StructField("mark", T.StringType()), T.StructField("bucket", T.LongType()),
                       T.StructField("bits", T.BinaryType())])


def marks(events: DataFrame, sessions: DataFrame, orders: DataFrame, status: str = COMPLETED, user: str = "user_id") -> DataFrame:
    """``GROUP``, bucket, bits of these rows.  Events are reduced to one row per (session, user, day, stage) before they meet
    their sessions, so a session of a third of all events is a few rows; an event without a known session keeps its place in F1 and F5."""
    seen = events.select("session_id", F.to_date("ts").alias("day"), F.col("event_type").alias("mark"), user).distinct()
    s = sessions.select("session_id", "device_type", "channel", F.lit(True).alias("in_session"))
    staged = seen.join(s, "session_id", "left").withColumn("in_session", F.coalesce("in_session", F.lit(False)))
    bought = orders.where(F.col("status") == status).select(
        F.col("order_date").alias("day"), F.lit(False).alias("in_session"), F.lit(None).cast("string").alias("device_type"),
        F.lit(None).cast("string").alias("channel"), F.lit(BUYER).alias("mark"), user)
    return bitmaps_of(staged.select(*GROUP, user).unionByName(bought), GROUP, user)


class UserMarks:
    """The stored table, one batch for each day or span of days."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = BatchStore(spark, path, SCHEMA)

    def add(self, events: DataFrame, sessions: DataFrame, orders: DataFrame, batch: str) -> None:
        """Take in a batch; the same batch again replaces its own rows."""
        self.store.write(marks(events, sessions, orders), batch)

    def table(self) -> DataFrame:
        return self.store.read().select(*SCHEMA.names)


def _wide(table: DataFrame, dims: Sequence[str], stages: Sequence[str], suffix: str = "") -> DataFrame:
    per_mark = members(table.where(F.col("mark").isNull() | (F.col("mark") != BUYER)), [*dims, "mark"], "n")
    return per_mark.groupBy(*dims).agg(*[F.coalesce(F.sum(F.when(F.col("mark") == s, F.col("n"))), F.lit(0)).cast("long").alias(f"{s}{suffix}")
                                         for s in stages])


def funnel_overall(table: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """F1 from the stored sets."""
    return wide_to_long(_wide(table, [], stages), [], list(stages), list(stages), "stage", "unique_users")


def funnel_by(table: DataFrame, dim: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """F3 (dim = device_type) and F4 (channel) from the stored sets."""
    wide = _wide(table.where("in_session"), [dim], stages)
    return Fn.by_dimension(wide, dim, stages)


def funnel_weekly(table: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """F5 from the stored sets."""
    return _wide(table.withColumn("week", period_key("day", "week")), ["week"], stages, "_users").transform(ordered("week"))


def kpi_customers(table: DataFrame) -> DataFrame:
    """T3 from the stored sets."""
    return members(table.where(F.col("mark") == BUYER), [], "customers").select(F.coalesce("customers", F.lit(0)).cast("long").alias("customers"))


def distinct_report(table: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """dimension, value, stage, users: F1, F3, F4, F5 and T3 in one long form, from one read of the stored sets.

    Each stored bitmap is handed to the four views that count it (overall, device, channel, week), or to that of the customers."""
    def view(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))

    in_session = F.col("in_session")
    of_stage = F.array(view("overall", F.lit(None)), view("week", period_key("day", "week")),
                       F.when(in_session, view("device_type", F.col("device_type"))), F.when(in_session, view("channel", F.col("channel"))))
    views = F.when(F.col("mark") == BUYER, F.array(view("customers", F.lit(None)))).otherwise(of_stage)
    each = table.where(F.col("mark").isin(BUYER, *stages)).select(F.explode(views).alias("v"), "mark", "bucket", "bits").where("v is not null")
    return members(each.select("v.dimension", "v.value", F.col("mark").alias("stage"), "bucket", "bits"), ["dimension", "value", "stage"], "users")
