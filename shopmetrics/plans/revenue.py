"""Revenue metrics (R1–R7b): monthly revenue, channel / device / subcategory / product
breakdowns, discount impact and repeat purchases.

Money columns are exact decimals until the last projection, which rounds half-up and
returns doubles.  Rows a conditional aggregate does not match still form their group
(R1–R3 filter inside the aggregate); R4–R7 filter in WHERE and drop such groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.functions.exprs import exact_avg, pct, period_key, period_name, round_n, share_pct
from shopmetrics.model import COMPLETED, MONEY
from shopmetrics.operators.aggregates import ordered, share_of_total, top_k


def _zero():
    return F.lit(0).cast(MONEY)


def _is_completed(status: str = COMPLETED):
    return F.col("status") == status


def _conditional_measures(status: str = COMPLETED) -> list:
    """COUNT / SUM / AVG of completed orders inside the aggregate (PF4, A7, A12)."""
    done = _is_completed(status)
    return [
        F.count(F.when(done, F.lit(1))).alias("total_orders"),
        F.sum(F.when(done, F.col("total_amount")).otherwise(_zero())).alias("_rev"),
        exact_avg(F.when(done, F.col("total_amount"))).alias("_aov"),
    ]


def revenue_monthly(orders: DataFrame, status: str = COMPLETED, grain: str = "month") -> DataFrame:
    """Month, total_orders, total_revenue, avg_order_value, total_discounts.

    Every month with any order appears; AOV is NULL where no order is completed.
    ``grain`` ("month", "week", "month_of_year") changes the time bucket."""
    done = _is_completed(status)
    key = period_name(grain)
    g = orders.groupBy(period_key("order_date", grain).alias(key)).agg(
        *_conditional_measures(status),
        F.sum(F.when(done, F.col("discount_amount")).otherwise(_zero())).alias("_disc"),
    )
    return g.select(
        key,
        "total_orders",
        round_n("_rev", 2).alias("total_revenue"),
        round_n("_aov", 2).alias("avg_order_value"),
        round_n("_disc", 2).alias("total_discounts"),
    ).transform(ordered(key))


def revenue_monthly_completed(orders: DataFrame, status: str = COMPLETED, grain: str = "month") -> DataFrame:
    """R1e: month, revenue over completed orders only (WHERE form)."""
    key = period_name(grain)
    g = (
        orders.where(_is_completed(status))
        .groupBy(period_key("order_date", grain).alias(key))
        .agg(F.sum("total_amount").alias("_rev"))
    )
    return g.select(key, round_n("_rev", 2).alias("revenue")).transform(ordered(key))


def _orders_by_session_dim(orders: DataFrame, sessions: DataFrame, dim: str, status: str) -> DataFrame:
    """orders ⋈ sessions grouped by a session column, with the completed-order measures.

    The measures are decomposable, so orders are first reduced per session_id (map-side
    partial sums): a session holding a third of all orders becomes one row before the
    join, and the join reuses that aggregation's partitioning."""
    done = _is_completed(status)
    per_session = orders.groupBy("session_id").agg(
        F.count(F.when(done, F.lit(1))).alias("_n"),
        F.sum(F.when(done, F.col("total_amount")).otherwise(_zero())).alias("_s"),
        F.sum(F.when(done, F.col("total_amount"))).alias("_sa"),
        F.count(F.when(done, F.col("total_amount"))).alias("_na"),
    )
    s = sessions.select("session_id", dim)
    return per_session.join(s, "session_id").groupBy(dim).agg(
        F.sum("_n").alias("total_orders"),
        F.coalesce(F.sum("_s"), _zero()).alias("_rev"),
        (F.sum("_sa").cast("double") / F.nullif(F.sum("_na"), F.lit(0)).cast("double")).alias("_aov"),
    )


def revenue_by_session_dim(orders: DataFrame, sessions: DataFrame, dim: str, status: str = COMPLETED,
                           share: str | None = "sql") -> DataFrame:
    """R2/R3 and their notebook variants.

    share: None (no share column), "sql" (share of the unrounded sums, 2 dp) or
    "rounded" (share of the already rounded revenues, 1 dp, as the notebooks do)."""
    g = _orders_by_session_dim(orders, sessions, dim, status)
    rev = round_n("_rev", 2)
    cols = [dim, "total_orders", rev.alias("total_revenue"), round_n("_aov", 2).alias("avg_order_value")]
    if share == "sql":
        cols.append(share_of_total("_rev", 2).alias("revenue_share_pct"))
    elif share == "rounded":
        cols.append(share_of_total(rev, None).alias("_share"))
    out = g.select(*cols)
    if share == "rounded":
        out = out.withColumn("revenue_share_pct", round_n("_share", 1)).drop("_share")
    return out.transform(ordered(F.col("total_revenue").desc(), F.col(dim)))


def revenue_by_channel(orders: DataFrame, sessions: DataFrame, status: str = COMPLETED) -> DataFrame:
    """R2: channel, total_orders, total_revenue, avg_order_value, revenue_share_pct."""
    return revenue_by_session_dim(orders, sessions, "channel", status, share="sql")


def revenue_by_device(orders: DataFrame, sessions: DataFrame, status: str = COMPLETED) -> DataFrame:
    """device_type, total_orders, total_revenue, avg_order_value."""
    return revenue_by_session_dim(orders, sessions, "device_type", status, share=None)


def _completed_ids(orders: DataFrame, status: str) -> DataFrame:
    """Ids of completed orders, to be hashed in a shuffled join: a few bytes an order, so the lines aren't sorted for it."""
    return orders.where(_is_completed(status)).select("order_id").hint("shuffle_hash")


def _completed_lines(order_items: DataFrame, products: DataFrame, orders: DataFrame,
                     product_cols: list[str], status: str) -> DataFrame:
    """order_items ⋈ products ⋈ completed orders (J3), orders last: the lines then lie by
    order_id, so counting distinct orders needs no further shuffle of them.

    No forced broadcast: products grows with the catalogue, so AQE decides from the
    runtime size (broadcast below spark.sql.autoBroadcastJoinThreshold, else a
    sort-merge join)."""
    oi = order_items.select("order_id", "product_id", "quantity", "unit_price")
    p = products.select("product_id", *product_cols)
    return oi.join(p, "product_id").join(_completed_ids(orders, status), "order_id")


def _order_marked(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines`` with ``_first``: true on one line of each order in each group of ``keys``.

    Counting those is counting distinct orders, but by a sort of narrow rows, which spills, and one map of the groups.
    COUNT(DISTINCT) keeps two maps of nearly every line, with all the sums in each entry, in the task that joined them."""
    one = Window.partitionBy("order_id", *keys).orderBy("order_id")
    return lines.withColumn("_first", F.row_number().over(one) == 1)


def _line_measures() -> list:
    """Measures of lines marked by :func:`_order_marked`."""
    line_rev = F.col("quantity") * F.col("unit_price")
    return [
        F.count(F.when(F.col("_first"), F.lit(1))).alias("total_orders"),
        F.sum("quantity").cast("long").alias("units_sold"),
        F.sum(line_rev).alias("_rev"),
        exact_avg("unit_price").alias("_avg_price"),
    ]


def _by_subcategory(order_items: DataFrame, products: DataFrame, orders: DataFrame, status: str) -> DataFrame:
    lines = _completed_lines(order_items, products, orders, ["subcategory", "cost"], status)
    profit = F.col("quantity") * (F.col("unit_price") - F.col("cost"))
    g = _order_marked(lines, ["subcategory"]).groupBy("subcategory").agg(*_line_measures(), F.sum(profit).alias("_profit"))
    return g.select(
        "subcategory",
        "total_orders",
        "units_sold",
        round_n("_rev", 2).alias("gross_revenue"),
        round_n("_avg_price", 2).alias("avg_unit_price"),
        round_n("_profit", 2).alias("gross_profit"),
    )


def revenue_by_subcategory(order_items: DataFrame, products: DataFrame, orders: DataFrame,
                           status: str = COMPLETED) -> DataFrame:
    """Subcategory, total_orders, units_sold, gross_revenue, avg_unit_price, gross_profit."""
    return _by_subcategory(order_items, products, orders, status) \
        .transform(ordered(F.col("gross_revenue").desc(), "subcategory"))


def revenue_by_subcategory_margin(order_items: DataFrame, products: DataFrame, orders: DataFrame,
                                  status: str = COMPLETED) -> DataFrame:
    """R4p: subcategory, orders, units_sold, gross_revenue, gross_profit, margin_pct
    (margin from the rounded revenue and profit, 1 dp)."""
    r4 = _by_subcategory(order_items, products, orders, status)
    return r4.select(
        "subcategory",
        F.col("total_orders").alias("orders"),
        "units_sold",
        "gross_revenue",
        "gross_profit",
        share_pct("gross_profit", "gross_revenue", 1).alias("margin_pct"),
    ).transform(ordered(F.col("gross_revenue").desc(), "subcategory"))


def top_products(order_items: DataFrame, products: DataFrame, orders: DataFrame, k: int = 10,
                 status: str = COMPLETED) -> DataFrame:
    """Top-k products by (rounded) revenue; ties broken by product_id.

    Lines of completed orders are aggregated per product_id first (partial aggregation
    map-side) and only then joined to products, so the product join sees one row per
    product instead of every line.  Equal to grouping by all product columns after the
    join because product_id is the products key."""
    oi = order_items.select("order_id", "product_id", "quantity", "unit_price")
    done = _completed_ids(orders, status)
    per_product = _order_marked(oi.join(done, "order_id"), ["product_id"]).groupBy("product_id").agg(*_line_measures())
    p = products.select("product_id", "product_name", "subcategory", "brand", "price")
    out = per_product.join(p, "product_id").select(
        "product_id", "product_name", "subcategory", "brand",
        F.col("price").cast("double").alias("price"),
        "total_orders", "units_sold",
        round_n("_rev", 2).alias("total_revenue"),
        round_n("_avg_price", 2).alias("avg_selling_price"),
    )
    return top_k(out, k, [F.col("total_revenue").desc(), F.col("product_id").asc()])


def top_products_by_name(order_items: DataFrame, products: DataFrame, orders: DataFrame, k: int = 10,
                         status: str = COMPLETED) -> DataFrame:
    """R5p: top-k (product_name, subcategory, brand) groups by revenue."""
    keys = ["product_name", "subcategory", "brand"]
    lines = _completed_lines(order_items, products, orders, keys, status)
    g = _order_marked(lines, keys).groupBy(*keys).agg(*_line_measures())
    out = g.select(*keys, F.col("total_orders").alias("orders"), "units_sold",
                   round_n("_rev", 2).alias("total_revenue"))
    order = [F.col("total_revenue").desc()] + [F.col(c).asc_nulls_first() for c in keys]
    return top_k(out, k, order)


def _discount_group():
    return F.when(F.col("discount_amount") > 0, F.lit("With Discount")).otherwise(F.lit("No Discount"))


def discount_impact(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """discount_group, total_orders, avg_order_value, total_revenue, avg_discount,
    avg_discount_pct = 100·AVG(discount) / AVG(total + discount)."""
    o = orders.where(_is_completed(status))
    g = o.groupBy(_discount_group().alias("discount_group")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        exact_avg("total_amount").alias("_aov"),
        F.sum("total_amount").alias("_rev"),
        exact_avg("discount_amount").alias("_avg_disc"),
        exact_avg(F.col("total_amount") + F.col("discount_amount")).alias("_avg_gross"),
    )
    return g.select(
        "discount_group",
        "total_orders",
        round_n("_aov", 2).alias("avg_order_value"),
        round_n("_rev", 2).alias("total_revenue"),
        round_n("_avg_disc", 2).alias("avg_discount"),
        pct("_avg_disc", "_avg_gross", 2).alias("avg_discount_pct"),
    ).transform(ordered("discount_group"))


def discount_monthly(orders: DataFrame, status: str = COMPLETED, grain: str = "month") -> DataFrame:
    """Month, total_orders, discounted_orders, discount_rate_pct,
    total_discounts_given, revenue_after_discounts (completed orders only)."""
    o = orders.where(_is_completed(status))
    key = period_name(grain)
    g = o.groupBy(period_key("order_date", grain).alias(key)).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count(F.when(F.col("discount_amount") > 0, F.lit(1))).alias("discounted_orders"),
        F.sum("discount_amount").alias("_disc"),
        F.sum("total_amount").alias("_rev"),
    )
    return g.select(
        key, "total_orders", "discounted_orders",
        pct("discounted_orders", "total_orders", 2).alias("discount_rate_pct"),
        round_n("_disc", 2).alias("total_discounts_given"),
        round_n("_rev", 2).alias("revenue_after_discounts"),
    ).transform(ordered(key))


def discount_trend(orders: DataFrame, status: str = COMPLETED, grain: str = "month") -> DataFrame:
    """R6b notebook form: month, discount_rate_pct (1 dp), total_discounts (0 dp)."""
    o = orders.where(_is_completed(status))
    key = period_name(grain)
    g = o.groupBy(period_key("order_date", grain).alias(key)).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("discount_amount") > 0, F.lit(1))).alias("_d"),
        F.sum("discount_amount").alias("_disc"),
    )
    return g.select(key, pct("_d", "_n", 1).alias("discount_rate_pct"),
                    round_n("_disc", 0).alias("total_discounts")).transform(ordered(key))


def user_order_counts(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """Per buyer: user_id, order_count (completed orders).  Partial aggregation keeps a
    heavy buyer's rows to one per map task before the shuffle."""
    return orders.where(_is_completed(status)).groupBy("user_id").agg(F.count(F.lit(1)).alias("order_count"))


def repeat_rate(orders: DataFrame, status: str = COMPLETED) -> DataFrame:
    """total_buyers, one_time_buyers, repeat_buyers, repeat_purchase_rate_pct,
    avg_orders_per_buyer (one row; 0 buyers gives 0 counts and NULL rates)."""
    u = user_order_counts(orders, status)
    g = u.agg(
        F.count(F.lit(1)).alias("total_buyers"),
        F.count(F.when(F.col("order_count") == 1, F.lit(1))).alias("one_time_buyers"),
        F.count(F.when(F.col("order_count") >= 2, F.lit(1))).alias("repeat_buyers"),
        exact_avg("order_count").alias("_avg"),
    )
    return g.select(
        "total_buyers", "one_time_buyers", "repeat_buyers",
        pct("repeat_buyers", "total_buyers", 2).alias("repeat_purchase_rate_pct"),
        round_n("_avg", 2).alias("avg_orders_per_buyer"),
    )


def orders_per_buyer(orders: DataFrame, status: str = COMPLETED, first: int | None = None) -> DataFrame:
    """orders_placed, num_users, pct_of_buyers (optionally the first ``first`` keys)."""
    u = user_order_counts(orders, status)
    g = u.groupBy(F.col("order_count").alias("orders_placed")).agg(F.count(F.lit(1)).alias("num_users"))
    out = g.select("orders_placed", "num_users", share_of_total("num_users", 2).alias("pct_of_buyers"))
    if first:
        return top_k(out, first, [F.col("orders_placed").asc()])
    return out.transform(ordered("orders_placed"))
