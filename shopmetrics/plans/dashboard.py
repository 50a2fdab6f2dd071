"""Dashboard measures (X1, T1–T12): the enriched order table, KPI tiles and the
worksheet aggregates built on it.

Worksheets filter ``status = completed`` unless noted; T6, T8 and T9 carry no status
filter.  T10 follows level-of-detail semantics: cohorts and their sizes come from the
first order of *any* status, and only the counted users are filtered to completed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.functions.exprs import exact_avg, month_diff, month_key, month_start, pct, ratio, round_n
from shopmetrics.model import COMPLETED
from shopmetrics.operators.aggregates import ordered
from shopmetrics.operators.lod import Computed, Fixed, view


def orders_enriched(orders: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Each order with its session's device and channel and its user's country, age
    group and acquisition channel (left joins: every order kept once per match)."""
    out = orders.join(sessions.select("session_id", "device_type", "channel"), "session_id", "left")
    out = out.join(users.select("user_id", "country", "age_group", "acquisition_channel"), "user_id", "left")
    return out.select(
        "order_id", "session_id", "user_id", "order_date", "total_amount", "discount_amount", "payment_method",
        "status", "device_type", "channel", "country", "age_group", "acquisition_channel")


def orders_enriched_output(orders: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """X1 as exported: dates as ISO text, money as double."""
    x = orders_enriched(orders, sessions, users)
    return x.withColumn("order_date", F.col("order_date").cast("string")) \
        .withColumn("total_amount", F.col("total_amount").cast("double")) \
        .withColumn("discount_amount", F.col("discount_amount").cast("double"))


def write_orders_enriched(orders: DataFrame, sessions: DataFrame, users: DataFrame, path: str,
                          fmt: str = "parquet", mode: str = "overwrite") -> None:
    """IO5: export X1 for dashboards (parquet, or CSV with a header)."""
    from shopmetrics.sources.io import write_table

    write_table(orders_enriched_output(orders, sessions, users), path, fmt, mode)


def filter_by_acquisition_channel(orders: DataFrame, users: DataFrame, channel: str | None) -> DataFrame:
    """PF14: the dashboard's filter action — keep the orders of users acquired through
    ``channel`` (a left semi join on user_id; unchanged when ``channel`` is None)."""
    if channel is None:
        return orders
    u = users.where(F.col("acquisition_channel") == channel).select("user_id")
    return orders.join(u, "user_id", "left_semi")


def _completed(df: DataFrame, status: str = COMPLETED) -> DataFrame:
    return df.where(F.col("status") == status)


def kpi_orders(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """orders = COUNT(order_id) of completed orders."""
    return _completed(orders, status).agg(F.count("order_id").alias("orders"))


def kpi_revenue(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """revenue = SUM(total_amount) of completed orders."""
    return _completed(orders, status).agg(round_n(F.sum("total_amount"), 2).alias("revenue"))


def kpi_customers(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """customers = COUNTD(user_id) of completed orders."""
    return _completed(orders, status).agg(F.count_distinct("user_id").alias("customers"))


def kpi_aov(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """T4: aov = AVG(total_amount) of completed orders."""
    return _completed(orders, status).agg(round_n(exact_avg("total_amount"), 2).alias("aov"))


def trend_month_part(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """T5: month (1–12, years merged), revenue, aov of completed orders."""
    g = _completed(orders, status).groupBy(F.month("order_date").alias("month")).agg(
        F.sum("total_amount").alias("_rev"), exact_avg("total_amount").alias("_aov"))
    return g.select("month", round_n("_rev", 2).alias("revenue"), round_n("_aov", 2).alias("aov")).transform(ordered("month"))


def revenue_by_payment(orders: DataFrame) -> DataFrame:
    """payment_method, revenue over all orders (no status filter)."""
    g = orders.groupBy("payment_method").agg(F.sum("total_amount").alias("_rev"))
    return g.select("payment_method", round_n("_rev", 2).alias("revenue")).transform(ordered(F.col("revenue").desc(), "payment_method"))


def _measures_by_key(orders: DataFrame, key: str, dimension: DataFrame, column: str) -> DataFrame:
    """``column``, sum and count of total_amount over orders left-joined to ``dimension`` on ``key``.

    Both measures add up, so orders are reduced per key first (map-side): one row per
    buyer or session and map task is shuffled, whatever the number of its orders, and a third
    of all orders on one key is one row before the join."""
    per_key = orders.groupBy(key).agg(F.sum("total_amount").alias("_s"), F.count("total_amount").alias("_n"))
    return per_key.join(dimension.select(key, column), key, "left").groupBy(column).agg(
        F.sum("_s").alias("_rev"), F.sum("_n").alias("_n"))


def revenue_by_acq_channel(orders: DataFrame, users: DataFrame, status: str = COMPLETED) -> DataFrame:
    """acquisition_channel, revenue, aov, avg_line (mean of the channel revenues,
    the reference line), completed orders, descending by revenue."""
    g = _measures_by_key(_completed(orders, status), "user_id", users, "acquisition_channel")
    line = F.avg(F.col("_rev").cast("double")).over(Window.partitionBy())
    return g.select("acquisition_channel", round_n("_rev", 2).alias("revenue"), round_n(ratio("_rev", "_n"), 2).alias("aov"),
                    round_n(line, 2).alias("avg_line")).transform(ordered(F.col("revenue").desc(), "acquisition_channel"))


def revenue_by_country(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Country, revenue over all orders (no status filter)."""
    g = _measures_by_key(orders, "user_id", users, "country")
    return g.select("country", round_n("_rev", 2).alias("revenue")).transform(ordered(F.col("revenue").desc(), "country"))


def revenue_by_device_all(orders: DataFrame, sessions: DataFrame) -> DataFrame:
    """device_type (session device), revenue over all orders, descending."""
    g = _measures_by_key(orders, "session_id", sessions, "device_type")
    return g.select("device_type", round_n("_rev", 2).alias("revenue")).transform(ordered(F.col("revenue").desc(), "device_type"))


def retention_lod(orders: DataFrame, status: str = COMPLETED, month_part: bool = False) -> DataFrame:
    """cohort_month, month_number, retained_users, cohort_size, retention (fraction).

    Cohort = month of the user's first order of any status; cohort size = all users of
    that cohort; retained = distinct users with a completed order in the month.
    Orders are reduced per (user, month) first, so the per-user cohort window sees a
    few rows per user, not a heavy buyer's raw orders.

    ``month_part=True`` labels rows by the cohort's month of year only (1–12), as the
    worksheet's MONTH pill does: cohorts of different years then share a row; their
    (disjoint) retained users add up and the size is the MIN over the merged cohorts,
    as ``COUNTD(user) / MIN(size)`` evaluates there."""
    um = orders.where(F.col("user_id").isNotNull()).groupBy("user_id", month_start("order_date").alias("order_start")).agg(
        F.max(F.when(F.col("status") == status, F.lit(1)).otherwise(F.lit(0))).alias("done"))
    um = um.withColumn("cohort_start", F.min("order_start").over(Window.partitionBy("user_id"))) \
        .withColumn("month_number", month_diff("cohort_start", "order_start"))
    cells = um.groupBy("cohort_start", "month_number").agg(
        F.count(F.when(F.col("done") == 1, F.lit(1))).alias("retained_users"),
        F.count(F.lit(1)).alias("users"))
    # Every user has a month-0 row, so the month-0 cell counts the whole cohort.
    size = F.max(F.when(F.col("month_number") == 0, F.col("users"))).over(Window.partitionBy("cohort_start"))
    c = cells.withColumn("cohort_size", size).where(F.col("retained_users") > 0)
    if month_part:
        c = c.groupBy(F.month("cohort_start").alias("cohort_month"), "month_number").agg(
            F.sum("retained_users").alias("retained_users"), F.min("cohort_size").alias("cohort_size"))
    else:
        c = c.withColumn("cohort_month", month_key("cohort_start"))
    return c.select("cohort_month", "month_number", "retained_users", "cohort_size",
                    ratio("retained_users", "cohort_size").alias("retention")) \
        .transform(ordered("cohort_month", "month_number"))


def retention_fixed(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """T10 as the worksheet states it, by level-of-detail expressions: the cohort is FIXED per user, its size FIXED per cohort,
    both before the status filter.  Same result as ``retention_lod``, which reduces orders per (user, month) first."""
    rows = orders.where(F.col("user_id").isNotNull()).select("user_id", "status", month_start("order_date").alias("order_start")).distinct()
    steps = [Fixed("cohort_start", ["user_id"], F.min("order_start")),
             Computed("month_number", month_diff("cohort_start", "order_start")),
             Fixed("cohort_size", ["cohort_start"], F.count_distinct("user_id"))]
    c = view(rows, steps, ["cohort_start", "month_number"],
             {"retained_users": F.count_distinct("user_id"), "cohort_size": F.min("cohort_size")}, where=F.col("status") == status)
    return c.select(month_key("cohort_start").alias("cohort_month"), "month_number", "retained_users", "cohort_size",
                    ratio("retained_users", "cohort_size").alias("retention")).transform(ordered("cohort_month", "month_number"))


def channel_payment_share(orders: DataFrame, users: DataFrame, status: str = COMPLETED, context: Column | None = None) -> DataFrame:
    """acquisition_channel, payment_method, revenue of completed orders, channel_revenue (FIXED per channel, all statuses) and
    share_pct of it; ``context`` filters orders before the FIXED expression."""
    o = orders.select("user_id", "order_date", "payment_method", "status", "total_amount")
    rows = o.join(users.select("user_id", "acquisition_channel"), "user_id", "left")
    c = view(rows, [Fixed("channel_revenue", ["acquisition_channel"], F.sum("total_amount"))], ["acquisition_channel", "payment_method"],
             {"_rev": F.sum("total_amount"), "_all": F.min("channel_revenue")}, where=F.col("status") == status, context=context)
    return c.select("acquisition_channel", "payment_method", round_n("_rev", 2).alias("revenue"), round_n("_all", 2).alias("channel_revenue"),
                    pct("_rev", "_all", 2).alias("share_pct")).transform(ordered("acquisition_channel", "payment_method"))


def kpi_conversion(events: DataFrame) -> DataFrame:
    """Purchases, page_views (event counts) and conversion_rate = purchases / page views."""
    g = events.agg(F.count(F.when(F.col("event_type") == "purchase", F.lit(1))).alias("purchases"),
                   F.count(F.when(F.col("event_type") == "page_view", F.lit(1))).alias("page_views"))
    return g.select("purchases", "page_views", ratio("purchases", "page_views").alias("conversion_rate"))


def kpi_repeat_rate(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """Buyers, repeat_buyers (2+ completed orders), repeat_buyer_rate (fraction)."""
    per_user = _completed(orders, status).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    g = per_user.agg(F.count(F.lit(1)).alias("buyers"),
                     F.count(F.when(F.col("n") >= 2, F.lit(1))).alias("repeat_buyers"))
    return g.select("buyers", "repeat_buyers", ratio("repeat_buyers", "buyers").alias("repeat_buyer_rate"))
