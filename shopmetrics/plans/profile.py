"""Data profile and quality metrics (E1–E16): table sizes, nulls, duplicate keys, date
ranges, category splits, histograms, a project summary and a constraint audit.

pandas ``value_counts`` / ``groupby`` drop NULL keys; the metrics that mirror them do too.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.functions.exprs import exact_avg, pct, round_n, share_pct
from shopmetrics.model import CHECKS, COMPLETED, FOREIGN_KEYS, key_of, required
from shopmetrics.operators import quality as Q
from shopmetrics.operators.aggregates import equal_width_histogram, ordered, value_counts
from shopmetrics.operators.funnel_ops import wide_to_long


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Table, rows, columns."""
    return Q.row_counts(tables)


def null_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Table, column, nulls, pct for columns that have nulls."""
    return Q.null_profile(tables)


def duplicate_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Table, key, duplicates (rows minus distinct key values)."""
    return Q.duplicate_keys(tables, keys or {n: key_of(n, df.columns) for n, df in tables.items()})


def date_ranges(sessions: DataFrame, orders: DataFrame) -> DataFrame:
    """Table, column, min_date, max_date."""
    def rng(df: DataFrame, table: str, c: str) -> DataFrame:
        return df.agg(F.min(c).cast("string").alias("min_date"), F.max(c).cast("string").alias("max_date")) \
            .select(F.lit(table).alias("table"), F.lit(c).alias("column"), "min_date", "max_date")
    return rng(sessions, "sessions", "session_date").unionByName(rng(orders, "orders", "order_date"))


def status_split(orders: DataFrame) -> DataFrame:
    """E5: status, pct of all orders (1 dp)."""
    vc = value_counts(orders.where(F.col("status").isNotNull()), "status", "n")
    total = F.sum("n").over(Window.partitionBy())
    return vc.select("status", share_pct("n", total, 1).alias("pct")).transform(ordered(F.col("pct").desc(), "status"))


DEMOGRAPHIC_DIMENSIONS = ["acquisition_channel", "country", "device_type", "age_group"]


def user_demographics(users: DataFrame, top_countries: int = 10) -> DataFrame:
    """Dimension, value, users: one scan of users unpivoted to (dimension, value),
    one grouped count; countries limited to the ``top_countries`` most frequent
    (ties by value), ranked by a window over the per-value counts only."""
    long = wide_to_long(users.select(*DEMOGRAPHIC_DIMENSIONS), [], DEMOGRAPHIC_DIMENSIONS, DEMOGRAPHIC_DIMENSIONS,
                        "dimension", "value")
    counts = long.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("users"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("users").desc(), F.col("value")))
    ranked = counts.withColumn("_rank", rank)
    return ranked.where((F.col("dimension") != "country") | (F.col("_rank") <= top_countries)) \
        .select("dimension", "value", "users").transform(ordered("dimension", F.col("users").desc(), "value"))


def sessions_daily(sessions: DataFrame) -> DataFrame:
    """session_date, sessions."""
    s = sessions.where(F.col("session_date").isNotNull())
    return value_counts(s, "session_date", "sessions").select(
        F.col("session_date").cast("string").alias("session_date"), "sessions").transform(ordered("session_date"))


def sessions_hourly(sessions: DataFrame) -> DataFrame:
    """session_hour, sessions."""
    s = sessions.where(F.col("session_hour").isNotNull())
    return value_counts(s, "session_hour", "sessions").transform(ordered("session_hour"))


def price_histogram(products: DataFrame, bins: int = 30) -> DataFrame:
    """Bin, lo, hi, count of product prices."""
    return equal_width_histogram(products, "price", bins).transform(ordered("bin"))


def avg_price_by_subcategory(products: DataFrame) -> DataFrame:
    """Subcategory, avg_price (2 dp), ascending by price."""
    p = products.where(F.col("subcategory").isNotNull())
    g = p.groupBy("subcategory").agg(exact_avg("price").alias("_avg"))
    return g.select("subcategory", round_n("_avg", 2).alias("avg_price")).transform(ordered("avg_price", "subcategory"))


def order_value_histogram(orders: DataFrame, bins: int = 40, status: str = COMPLETED) -> DataFrame:
    """Bin, lo, hi, count of completed order totals, plus their mean (2 dp)."""
    done = orders.where(F.col("status") == status)
    return equal_width_histogram(done, "total_amount", bins, "mean_order_value").transform(ordered("bin"))


def payment_method_counts(orders: DataFrame) -> DataFrame:
    """payment_method, orders (all statuses)."""
    o = orders.where(F.col("payment_method").isNotNull())
    return value_counts(o, "payment_method", "orders").transform(ordered(F.col("orders").desc(), "payment_method"))


def event_type_counts(events: DataFrame) -> DataFrame:
    """event_type, events."""
    e = events.where(F.col("event_type").isNotNull())
    return value_counts(e, "event_type", "events").transform(ordered(F.col("events").desc(), "event_type"))


def products_per_subcategory(products: DataFrame) -> DataFrame:
    """Subcategory, products, descending."""
    p = products.where(F.col("subcategory").isNotNull())
    return value_counts(p, "subcategory", "products").transform(ordered(F.col("products").desc(), "subcategory"))


def project_summary(users: DataFrame, sessions: DataFrame, events: DataFrame, orders: DataFrame,
                    status: str = COMPLETED) -> DataFrame:
    """Metric, value — headline numbers of the whole data set, one row each.

    session_to_purchase_pct divides all orders by all sessions; repeat_buyer_pct is the
    share of completed-order buyers with two or more completed orders.  The four tables
    are scanned once each into a single aggregation; the repeat rate needs one grouping
    per buyer."""
    money = {"_done": "int", "_total": "decimal(18,2)", "_disc": "decimal(18,2)"}
    order_cols = {"_done": (F.col("status") == status).cast("int"), "_total": F.col("total_amount"),
                  "_disc": F.col("discount_amount")}
    u = Q.tagged_union({"users": users, "sessions": sessions, "events": events, "orders": orders},
                       {"orders": order_cols}, money)
    is_o, done = F.col("_t") == "orders", (F.col("_t") == "orders") & (F.col("_done") == 1)
    g = u.agg(
        F.count(F.when(F.col("_t") == "users", F.lit(1))).alias("users"),
        F.count(F.when(F.col("_t") == "sessions", F.lit(1))).alias("sessions"),
        F.count(F.when(F.col("_t") == "events", F.lit(1))).alias("events"),
        F.count(F.when(is_o, F.lit(1))).alias("_orders"),
        F.count(F.when(done, F.lit(1))).alias("completed_orders"),
        F.sum(F.when(done, F.col("_total"))).alias("_rev"),
        exact_avg(F.when(done, F.col("_total"))).alias("_aov"),
        F.sum(F.when(done, F.col("_disc"))).alias("_disc"),
    )
    values = {
        "users": F.col("users"), "sessions": F.col("sessions"), "events": F.col("events"),
        "completed_orders": F.col("completed_orders"),
        "total_revenue": round_n("_rev", 2), "avg_order_value": round_n("_aov", 2),
        "total_discounts": round_n("_disc", 2),
        "session_to_purchase_pct": pct("_orders", "sessions", 1),
    }
    wide = g.select(*[e.cast("double").alias(k) for k, e in values.items()])
    metrics = wide_to_long(wide, [], list(values), list(values), "metric", "value")
    per_user = orders.where(F.col("status") == status).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    repeat = per_user.agg(pct(F.count(F.when(F.col("n") >= 2, F.lit(1))), F.count(F.lit(1)), 1).alias("value")) \
        .select(F.lit("repeat_buyer_pct").alias("metric"), "value")
    return metrics.unionByName(repeat)


def rule_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rule, violations — the declared PK / NOT NULL / CHECK / FK rules of the
    schema, counted rather than enforced (no storage engine here to enforce them).

    Every table is read once, and one grouping over all keys, references and broken conditions
    counts everything (``operators/quality.py:audit``)."""
    def unique(name: str) -> str:
        return f"primary_key_unique:{name}({','.join(key_of(name, tables[name].columns))})"

    audits = []
    for name, df in tables.items():
        conditions = [(f"`{c}` is null", f"not_null:{name}.{c}") for c in required(name, df.columns) if c in df.columns]
        conditions += [("`{}` is not null and `{}` not in ({})".format(c, c, ", ".join(f"'{v}'" for v in allowed)), f"check:{t}.{c}")
                       for t, c, allowed in CHECKS if t == name]
        references = [(c, unique(parent), f"foreign_key:{name}.{c}->{parent}.{pc}")
                      for child, c, parent, pc in FOREIGN_KEYS if child == name and parent in tables]
        audits.append(Q.Audit(df, key_of(name, df.columns), unique(name), references, conditions))
    return Q.audit(audits)
