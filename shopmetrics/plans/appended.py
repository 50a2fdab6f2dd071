"""Queries over tables that arrive in batches: the driver's orders, dealt to batches by their date and taken in one after
the other.

Also loads and partitioned stores of the same orders.  Each batch is stored below the session's checkpoint folder, and the result must equal the metric over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.model import COMPLETED, ORDERS, STATUSES
from shopmetrics.plans import cohort, revenue
from shopmetrics.plans.cohort_state import CohortState, corrections, signed
from shopmetrics.plans.user_marks import UserMarks, distinct_report
from shopmetrics.sources import io, load, monthly
from shopmetrics.sources.batches import KeyedTable, work_folder

#: Whether an order is in the first half of its year; orders without a date aren't.
SPRING = "coalesce(month(order_date) <= 6, false)"


def cohort_report_appended(orders: DataFrame) -> DataFrame:
    """C1–C8 (``cohort.cell_report``) from a state kept up by three batches.

    Orders of the first half of each year come first, the others second (so that first months move back); returned
    orders are still completed then.  The third batch takes these back."""
    state = CohortState(orders.sparkSession, work_folder(orders.sparkSession), buckets=16)
    returned = F.col("status") == STATUSES[1]
    early = orders.withColumn("status", F.when(returned, F.lit(COMPLETED)).otherwise(F.col("status")))
    state.apply(signed(early.where(SPRING)), "spring")
    state.apply(signed(early.where(f"not {SPRING}")), "autumn")
    late = orders.where(returned)
    state.apply(corrections(late.withColumn("status", F.lit(COMPLETED)), late), "returned")
    return cohort.cell_report(state.cells())


def orders_appended(orders: DataFrame) -> DataFrame:
    """status, orders, revenue of orders appended by key, and a row "refused" with the number of refused rows.

    The first batch has the orders of the first half of each year, the second all of them, and the second is written
    twice as a retry would: every order gets in once, and the second batch's repeated ones are refused."""
    table = KeyedTable(orders.sparkSession, work_folder(orders.sparkSession), "orders")
    rows = orders.select(*ORDERS.names)
    for batch, part in (("first", rows.where(SPRING)), ("second", rows), ("second", rows)):
        table.append(part, batch)
    kept = table.read().groupBy("status").agg(F.count(F.lit(1)).alias("orders"), F.sum("total_amount").cast("double").alias("revenue"))
    refused = table.refused("second").agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("orders"))
    return kept.unionByName(refused.select(F.lit("refused").alias("status"), "orders", F.lit(None).cast("double").alias("revenue")))


def distinct_users_appended(events: DataFrame, sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """F1, F3, F4, F5 and T3 (``user_marks.distinct_report``) from user bitmaps of two batches: days up to the 15th of each
    month, and the days after."""
    store = UserMarks(events.sparkSession, work_folder(events.sparkSession))
    early, bought = "coalesce(day(ts) <= 15, false)", "coalesce(day(order_date) <= 15, false)"
    store.add(events.where(early), sessions, orders.where(bought), "first_half")
    store.add(events.where(f"not {early}"), sessions, orders.where(f"not {bought}"), "second_half")
    return distinct_report(store.table())


def load_rejects(orders: DataFrame) -> DataFrame:
    """column, reason, records of a CSV export of the orders in which cancelled orders have no number as their total and
    returned ones no date; accepted records have the reason "accepted"."""
    spark, root = orders.sparkSession, work_folder(orders.sparkSession)
    spoiled = orders.select(*ORDERS.names).withColumn("total_amount", F.when(F.col("status") == STATUSES[2], F.lit("n/a")).otherwise(F.col("total_amount").cast("string")))
    spoiled = spoiled.withColumn("order_date", F.when(F.col("status") != STATUSES[1], F.col("order_date")))
    io.write_table(spoiled, f"{root}/export", "csv")
    done = load.load_csv(spark, f"{root}/export", "orders", f"{root}/orders", multiline=False)
    good = done.rows().agg(F.lit(None).cast("string").alias("column"), F.lit("accepted").alias("reason"), F.count(F.lit(1)).alias("records"))
    return good.unionByName(done.rejects().groupBy("column", "reason").agg(F.count(F.lit(1)).alias("records")))


#: The first and last day of ``monthly_span``.
SPAN = ("1996-03-01", "1996-04-30")


def monthly_span(orders: DataFrame) -> DataFrame:
    """R1e over two months of orders stored by month: only these months' folders are read."""
    path = work_folder(orders.sparkSession)
    monthly.write_monthly(orders.select(*ORDERS.names), "orders", path)
    return revenue.revenue_monthly_completed(monthly.read_span(orders.sparkSession, "orders", path, *SPAN))
