"""Cohort metrics (C1–C8): monthly cohorts by first completed purchase, retention, cohort
revenue, per-user value, retention / revenue matrices and cumulative lifetime value.

Everything derives from one long-form frame, ``cohort_activity``: one row per (buyer,
purchase month) with that month's order count and revenue, tagged with the buyer's
cohort month.  Completed orders are first reduced per (user, month) with map-side
partial aggregation, so a buyer with a third of all orders contributes only a handful of
rows to every later shuffle; the cohort (first month) is then a window over those few
rows per user, not a self join over raw orders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.functions.exprs import month_diff, month_key, month_start, pct, ratio, round_n, share_pct
from shopmetrics.model import COMPLETED
from shopmetrics.operators.aggregates import ordered
from shopmetrics.operators.reshape import pivot_wide

#: Salts over which one buyer's orders are spread where a row per order is put out.
SALTS = 16


def cohort_activity(orders: DataFrame, status: str | None = COMPLETED) -> DataFrame:
    """user_id, cohort_start, order_start (first days of months), month_number,
    n_orders, n_amounts, revenue (exact decimal).  Orders without a buyer belong to no cohort."""
    o = orders.where(F.col("user_id").isNotNull())
    o = o if status is None else o.where(F.col("status") == status)
    um = o.groupBy("user_id", month_start("order_date").alias("order_start")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count("total_amount").alias("n_amounts"),
        F.sum("total_amount").alias("revenue"),
    )
    return with_cohort(um)


def with_cohort(months: DataFrame) -> DataFrame:
    """Rows per (user_id, order_start) with the buyer's cohort_start and the month_number."""
    cohort = F.min("order_start").over(Window.partitionBy("user_id"))
    return months.withColumn("cohort_start", cohort).withColumn(
        "month_number", month_diff("cohort_start", "order_start"))


def with_size(cells: DataFrame) -> DataFrame:
    """Cells with the cohort's size (= its month-0 users), a window over the aggregated cells."""
    size = F.max(F.when(F.col("month_number") == 0, F.col("users"))).over(Window.partitionBy("cohort_start"))
    return cells.withColumn("cohort_size", size)


def _cells(activity: DataFrame) -> DataFrame:
    """Per observed (cohort, month): users, orders, revenue and the cohort's size."""
    return with_size(activity.groupBy("cohort_start", "order_start", "month_number").agg(
        F.count(F.lit(1)).alias("users"),
        F.sum("n_orders").alias("orders"),
        F.sum("n_amounts").alias("amounts"),
        F.sum("revenue").alias("revenue"),
    ))


def cells_of_months(months: DataFrame) -> DataFrame:
    """Cells from rows per (user_id, order_start): n_orders, n_amounts, revenue."""
    return _cells(with_cohort(months))


def cohort_cells(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """The shared long form: one row per observed (cohort, purchase month) with users,
    orders, amounts, revenue and the cohort's size.  Small (cohorts x months)."""
    return _cells(cohort_activity(orders, status))


def _sizes(cells: DataFrame) -> DataFrame:
    m0 = cells.where(F.col("month_number") == 0)
    return m0.select(month_key("cohort_start").alias("cohort_month"), F.col("users").alias("cohort_size"),
                     F.col("users").alias("users_in_cohort")).transform(ordered("cohort_month"))


def _retention(cells: DataFrame) -> DataFrame:
    return cells.select(
        month_key("cohort_start").alias("cohort_month"),
        month_key("order_start").alias("purchase_month"),
        "cohort_size",
        F.col("users").alias("retained_users"),
        pct("users", "cohort_size", 2).alias("retention_pct"),
        "month_number",
    ).transform(ordered("cohort_month", "month_number"))


def _revenue(cells: DataFrame) -> DataFrame:
    return cells.select(
        month_key("cohort_start").alias("cohort_month"),
        month_key("order_start").alias("purchase_month"),
        "month_number",
        F.col("orders").alias("total_orders"),
        round_n("revenue", 2).alias("cohort_revenue"),
        round_n(ratio("revenue", "amounts"), 2).alias("avg_order_value"),
    ).transform(ordered("cohort_month", "month_number"))


def _per_cohort(cells: DataFrame) -> DataFrame:
    """Per cohort: size, orders, revenue.  Every buyer has a month-0 cell, so per-user
    averages are cohort totals over the cohort size."""
    return cells.groupBy("cohort_start").agg(
        F.max("cohort_size").alias("cohort_size"),
        F.sum("orders").cast("long").alias("total_orders"),
        F.sum("revenue").alias("_rev"),
    )


def _user_value(cells: DataFrame) -> DataFrame:
    g = _per_cohort(cells)
    return g.select(
        month_key("cohort_start").alias("cohort_month"),
        "cohort_size",
        "total_orders",
        round_n(ratio("total_orders", "cohort_size"), 2).alias("avg_orders_per_user"),
        round_n("_rev", 2).alias("total_revenue"),
        round_n(ratio("_rev", "cohort_size"), 2).alias("avg_revenue_per_user"),
        round_n(ratio("_rev", "total_orders"), 2).alias("avg_order_value"),
    ).transform(ordered("cohort_month"))


def _engagement(cells: DataFrame) -> DataFrame:
    g = _per_cohort(cells)
    return g.select(month_key("cohort_start").alias("cohort_month"), "cohort_size", "total_orders",
                    round_n(ratio("total_orders", "cohort_size"), 2).alias("avg_orders")) \
        .transform(ordered("cohort_month"))


_BY_CELL = ("cohort_month", "month_number")


def _retention_long(cells: DataFrame) -> DataFrame:
    return cells.select(month_key("cohort_start").alias("cohort_month"), "month_number",
                        share_pct("users", "cohort_size", 1).alias("retention_pct"))


def _revenue_long(cells: DataFrame) -> DataFrame:
    return cells.select(month_key("cohort_start").alias("cohort_month"), "month_number",
                        round_n("revenue", 0).alias("revenue"))


def _ltv_long(cells: DataFrame) -> DataFrame:
    c = cells.withColumn("cell", round_n("revenue", 0))
    w = Window.partitionBy("cohort_start").orderBy("month_number").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cum = F.sum("cell").over(w)
    return c.select(month_key("cohort_start").alias("cohort_month"), "month_number",
                    round_n(cum / F.col("cohort_size").cast("double"), 2).alias("ltv"))


def _retention_matrix(cells: DataFrame) -> DataFrame:
    return _retention_long(cells).transform(ordered(*_BY_CELL))


def _revenue_matrix(cells: DataFrame) -> DataFrame:
    return _revenue_long(cells).transform(ordered(*_BY_CELL))


def _ltv(cells: DataFrame) -> DataFrame:
    return _ltv_long(cells).transform(ordered(*_BY_CELL))


def _ltv_latest(cells: DataFrame) -> DataFrame:
    return _ltv_long(cells).groupBy("cohort_month").agg(F.max_by("ltv", "month_number").alias("ltv")) \
        .transform(ordered("cohort_month"))


def cohort_sizes(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """cohort_month, cohort_size, users_in_cohort (equal by construction)."""
    return _sizes(cohort_cells(orders, status))


def cohort_retention(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """cohort_month, purchase_month, cohort_size, retained_users, retention_pct,
    month_number (the intended month index, not the NULL the SQLite text yields)."""
    return _retention(cohort_cells(orders, status))


def cohort_base(orders: DataFrame, status: str = COMPLETED, salts: int = SALTS) -> DataFrame:
    """C2p: one row per completed order with its month, cohort month and month number.

    The per-user first month is an aggregate (map-side partial minimums) joined back on
    (user_id, salt): an order's salt is a hash of its id, and the one row of each user is
    repeated for every salt, so the orders of a buyer who placed a third of all are spread over
    ``salts`` tasks at any size."""
    o = orders.where((F.col("status") == status) & F.col("user_id").isNotNull()).select(
        "order_id", "user_id", "order_date", month_start("order_date").alias("order_start"))
    first = o.groupBy("user_id").agg(F.min("order_start").alias("cohort_start"))
    first = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    j = o.withColumn("_salt", F.pmod(F.hash("order_id"), F.lit(salts))).join(first, ["user_id", "_salt"])
    return j.select(
        "order_id", "user_id", F.col("order_date").cast("string").alias("order_date"),
        month_key("order_start").alias("order_month"),
        month_key("cohort_start").alias("cohort_month"),
        month_diff("cohort_start", "order_start").alias("month_number"),
    )


def cohort_span(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """C2p's figures: cohorts (number of cohort months) and max_month_number, from the few rows per
    (buyer, month)."""
    return cohort_activity(orders, status).agg(F.count_distinct("cohort_start").alias("cohorts"),
                                               F.max("month_number").alias("max_month_number"))


def cohort_revenue(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """cohort_month, purchase_month, month_number, total_orders, cohort_revenue,
    avg_order_value."""
    return _revenue(cohort_cells(orders, status))


def cohort_user_value(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """C4: cohort_month, cohort_size, total_orders, avg_orders_per_user, total_revenue,
    avg_revenue_per_user, avg_order_value."""
    return _user_value(cohort_cells(orders, status))


def cohort_engagement(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """C4p: cohort_month, cohort_size, total_orders, avg_orders (2 dp)."""
    return _engagement(cohort_cells(orders, status))


def retention_matrix(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """C5 long form: cohort_month, month_number, retention_pct (1 dp), observed cells only."""
    return _retention_matrix(cohort_cells(orders, status))


def revenue_matrix(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """C6 long form: cohort_month, month_number, revenue rounded to whole currency."""
    return _revenue_matrix(cohort_cells(orders, status))


def ltv_curve(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """C7 long form: cohort_month, month_number, ltv = cumulative rounded cohort revenue
    / cohort size (2 dp).  Cells are rounded before accumulating, as the matrix is."""
    return _ltv(cohort_cells(orders, status))


def ltv_latest(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """cohort_month, ltv at the cohort's last observed month."""
    return _ltv_latest(cohort_cells(orders, status))


def retention_matrix_wide(orders: DataFrame, status: str = COMPLETED,
                          months: Sequence[int] | None = None) -> DataFrame:
    """C5 as a matrix: cohort_month, M0, M1, ... (one column per observed month number)."""
    return pivot_wide(_retention_long(cohort_cells(orders, status)), *_BY_CELL, "retention_pct", "M", months)


def revenue_matrix_wide(orders: DataFrame, status: str = COMPLETED,
                        months: Sequence[int] | None = None) -> DataFrame:
    """C6 as a matrix: cohort_month, M0, M1, ..."""
    return pivot_wide(_revenue_long(cohort_cells(orders, status)), *_BY_CELL, "revenue", "M", months)


def ltv_matrix_wide(orders: DataFrame, status: str = COMPLETED,
                    months: Sequence[int] | None = None) -> DataFrame:
    """C7 as a matrix: cohort_month, M0, M1, ... (NULL where the month is unobserved)."""
    return pivot_wide(_ltv_long(cohort_cells(orders, status)), *_BY_CELL, "ltv", "M", months)


def cohort_report(orders: DataFrame, status: str = COMPLETED) -> dict[str, DataFrame]:
    """All cohort metrics from one computation of the shared cells.

    The orders scan, the per-(user, month) reduction and the cohort window run once: the small
    cells frame is persisted, and every metric — sizes, retention, revenue, per-user value,
    matrices, LTV — is a cheap projection or aggregate of it."""
    cells = cohort_cells(orders, status).persist()
    out = report_of(cells)
    out["retention_matrix_wide"] = pivot_wide(_retention_long(cells), *_BY_CELL, "retention_pct", "M")
    out["revenue_matrix_wide"] = pivot_wide(_revenue_long(cells), *_BY_CELL, "revenue", "M")
    out["ltv_matrix_wide"] = pivot_wide(_ltv_long(cells), *_BY_CELL, "ltv", "M")
    return out


def report_of(cells: DataFrame) -> dict[str, DataFrame]:
    """The metrics of C1–C8 in long form from their cells."""
    return {
        "cohort_sizes": _sizes(cells),
        "cohort_retention": _retention(cells),
        "cohort_revenue": _revenue(cells),
        "cohort_user_value": _user_value(cells),
        "cohort_engagement": _engagement(cells),
        "retention_matrix": _retention_matrix(cells),
        "revenue_matrix": _revenue_matrix(cells),
        "ltv_curve": _ltv(cells),
        "ltv_latest": _ltv_latest(cells),
    }


def cell_report(cells: DataFrame) -> DataFrame:
    """C1–C8 side by side, one row per (cohort, month): size, retention, revenue and cumulative value of the cell, and the
    totals of the whole cohort (windows over the few cells)."""
    whole = Window.partitionBy("cohort_start")
    so_far = whole.orderBy("month_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    orders, revenue = F.sum("orders").over(whole), F.sum("revenue").over(whole)
    return cells.select(
        month_key("cohort_start").alias("cohort_month"), month_key("order_start").alias("purchase_month"), "month_number", "cohort_size",
        F.col("users").alias("retained_users"), pct("users", "cohort_size", 2).alias("retention_pct"),
        share_pct("users", "cohort_size", 1).alias("retention_pct_1"), F.col("orders").alias("total_orders"),
        round_n("revenue", 2).alias("cohort_revenue"), round_n(ratio("revenue", "amounts"), 2).alias("avg_order_value"),
        round_n(F.sum(round_n("revenue", 0)).over(so_far) / F.col("cohort_size").cast("double"), 2).alias("ltv"),
        orders.cast("long").alias("cohort_orders"), round_n(ratio(orders, "cohort_size"), 2).alias("avg_orders_per_user"),
        round_n(revenue, 2).alias("total_revenue"), round_n(ratio(revenue, "cohort_size"), 2).alias("avg_revenue_per_user"))
