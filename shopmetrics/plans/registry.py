"""Named metrics: ``name -> callable(spark, sf_dir) -> DataFrame``.

Each callable derives the canonical tables from the driver's parquet files in ``sf_dir``
(lazily; see :func:`shopmetrics.sources.adapters.driver_tables`) and applies one metric.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shopmetrics.plans import appended as A
from shopmetrics.plans import cohort as C
from shopmetrics.plans import dashboard as D
from shopmetrics.plans import funnel as Fn
from shopmetrics.plans import profile as P
from shopmetrics.plans import revenue as R
from shopmetrics.sources import footers
from shopmetrics.sources.adapters import DriverTables, driver_tables

Query = Callable[[SparkSession, str], DataFrame]

# The dashboard filter action (PF14) is exercised with one acquisition channel value.
FILTER_CHANNEL = "BUILDING"


def _q(fn: Callable[[DriverTables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(driver_tables(spark, sf_dir))

    run.__doc__ = fn.__doc__
    return run


def revenue_queries() -> dict[str, Query]:
    return {
        "revenue_monthly": _q(lambda t: R.revenue_monthly(t.orders)),
        "revenue_weekly": _q(lambda t: R.revenue_monthly(t.orders, grain="week")),
        "revenue_month_of_year": _q(lambda t: R.revenue_monthly(t.orders, grain="month_of_year")),
        "revenue_monthly_completed": _q(lambda t: R.revenue_monthly_completed(t.orders)),
        "revenue_by_channel": _q(lambda t: R.revenue_by_channel(t.orders, t.sessions)),
        "revenue_by_device": _q(lambda t: R.revenue_by_device(t.orders, t.sessions)),
        "revenue_by_channel_nb": _q(lambda t: R.revenue_by_session_dim(t.orders, t.sessions, "channel",
                                                                       share="rounded")),
        "revenue_by_device_nb": _q(lambda t: R.revenue_by_session_dim(t.orders, t.sessions, "device_type",
                                                                      share="rounded")),
        "revenue_by_subcategory": _q(lambda t: R.revenue_by_subcategory(t.order_items, t.products, t.orders)),
        "revenue_by_subcategory_margin": _q(
            lambda t: R.revenue_by_subcategory_margin(t.order_items, t.products, t.orders)),
        "top_products": _q(lambda t: R.top_products(t.order_items, t.products, t.orders, k=10)),
        "top_products_by_name": _q(lambda t: R.top_products_by_name(t.order_items, t.products, t.orders, k=10)),
        "discount_impact": _q(lambda t: R.discount_impact(t.orders)),
        "discount_monthly": _q(lambda t: R.discount_monthly(t.orders)),
        "discount_trend": _q(lambda t: R.discount_trend(t.orders)),
        "repeat_rate": _q(lambda t: R.repeat_rate(t.orders)),
        "orders_per_buyer": _q(lambda t: R.orders_per_buyer(t.orders)),
        "orders_per_buyer_nb": _q(lambda t: R.orders_per_buyer(t.orders, first=10)),
    }


def funnel_queries() -> dict[str, Query]:
    return {
        "funnel_overall": _q(lambda t: Fn.funnel_overall(t.events)),
        "funnel_rates": _q(lambda t: Fn.funnel_rates(t.events)),
        "funnel_share_of_max": _q(lambda t: Fn.funnel_share_of_max(t.events)),
        "funnel_transitions": _q(lambda t: Fn.funnel_transitions(t.events)),
        "funnel_by_device": _q(lambda t: Fn.funnel_by_device(t.events, t.sessions)),
        "funnel_by_channel": _q(lambda t: Fn.funnel_by_channel(t.events, t.sessions)),
        "funnel_by_device_nb": _q(lambda t: Fn.funnel_by_dimension(t.events, t.sessions, "device_type",
                                                                    style="nb")),
        "funnel_by_channel_nb": _q(lambda t: Fn.funnel_by_dimension(t.events, t.sessions, "channel", style="nb")),
        "funnel_by_device_long": _q(lambda t: Fn.funnel_by_device_long(t.events, t.sessions)),
        "funnel_weekly": _q(lambda t: Fn.funnel_weekly(t.events)),
        "funnel_weekly_nb": _q(lambda t: Fn.funnel_weekly(t.events, style="nb")),
        "funnel_by_age": _q(lambda t: Fn.funnel_by_age(t.events, t.users)),
        "cart_abandonment": _q(lambda t: Fn.cart_abandonment(t.events, t.order_items, t.orders, t.products)),
        "cart_abandonment_nb": _q(lambda t: Fn.cart_abandonment(t.events, t.order_items, t.orders, t.products,
                                                                k=15, dp=1, rate_col="abandonment_pct")),
    }


def cohort_queries() -> dict[str, Query]:
    names = ["cohort_sizes", "cohort_retention", "cohort_base", "cohort_span", "cohort_revenue", "cohort_user_value",
             "cohort_engagement", "retention_matrix", "revenue_matrix", "ltv_curve", "ltv_latest",
             "retention_matrix_wide", "revenue_matrix_wide", "ltv_matrix_wide"]
    return {n: _q(lambda t, fn=getattr(C, n): fn(t.orders)) for n in names}


def profile_queries() -> dict[str, Query]:
    return {
        "table_profile": _q(lambda t: P.table_profile(t.as_dict())),
        "null_profile": _q(lambda t: P.null_profile(t.as_dict())),
        "duplicate_keys": _q(lambda t: P.duplicate_keys(t.as_dict())),
        "date_ranges": _q(lambda t: P.date_ranges(t.sessions, t.orders)),
        "status_split": _q(lambda t: P.status_split(t.orders)),
        "user_demographics": _q(lambda t: P.user_demographics(t.users)),
        "sessions_daily": _q(lambda t: P.sessions_daily(t.sessions)),
        "sessions_hourly": _q(lambda t: P.sessions_hourly(t.sessions)),
        "price_histogram": _q(lambda t: P.price_histogram(t.products)),
        "avg_price_by_subcategory": _q(lambda t: P.avg_price_by_subcategory(t.products)),
        "order_value_histogram": _q(lambda t: P.order_value_histogram(t.orders)),
        "payment_method_counts": _q(lambda t: P.payment_method_counts(t.orders)),
        "project_summary": _q(lambda t: P.project_summary(t.users, t.sessions, t.events, t.orders)),
        "event_type_counts": _q(lambda t: P.event_type_counts(t.events)),
        "products_per_subcategory": _q(lambda t: P.products_per_subcategory(t.products)),
        "footer_row_counts": lambda spark, sf_dir: footers.row_counts(
            spark, {n: f"{sf_dir.rstrip('/')}/{n}.parquet" for n in DriverTables.RAW}).select("table", "rows"),
        "rule_violations": _q(lambda t: P.rule_violations(t.as_dict())),
    }


def dashboard_queries() -> dict[str, Query]:
    return {
        "orders_enriched": _q(lambda t: D.orders_enriched_output(t.orders, t.sessions, t.users)),
        "kpi_orders": _q(lambda t: D.kpi_orders(t.orders)),
        "kpi_revenue": _q(lambda t: D.kpi_revenue(t.orders)),
        "kpi_customers": _q(lambda t: D.kpi_customers(t.orders)),
        "kpi_aov": _q(lambda t: D.kpi_aov(t.orders)),
        "trend_month_part": _q(lambda t: D.trend_month_part(t.orders)),
        "revenue_by_payment": _q(lambda t: D.revenue_by_payment(t.orders)),
        "revenue_by_acq_channel": _q(lambda t: D.revenue_by_acq_channel(t.orders, t.users)),
        "revenue_by_country": _q(lambda t: D.revenue_by_country(t.orders, t.users)),
        "revenue_by_device_all": _q(lambda t: D.revenue_by_device_all(t.orders, t.sessions)),
        "retention_lod": _q(lambda t: D.retention_lod(t.orders)),
        "retention_fixed": _q(lambda t: D.retention_fixed(t.orders)),
        "channel_payment_share": _q(lambda t: D.channel_payment_share(t.orders, t.users)),
        "retention_lod_month_part": _q(lambda t: D.retention_lod(t.orders, month_part=True)),
        "revenue_monthly_acq_filtered": _q(lambda t: R.revenue_monthly(
            D.filter_by_acquisition_channel(t.orders, t.users, FILTER_CHANNEL))),
        "top_products_acq_filtered": _q(lambda t: R.top_products(
            t.order_items, t.products, D.filter_by_acquisition_channel(t.orders, t.users, FILTER_CHANNEL))),
        "kpi_conversion": _q(lambda t: D.kpi_conversion(t.events)),
        "kpi_repeat_rate": _q(lambda t: D.kpi_repeat_rate(t.orders)),
    }


def appended_queries() -> dict[str, Query]:
    return {
        "cohort_report_appended": _q(lambda t: A.cohort_report_appended(t.orders)),
        "distinct_users_appended": _q(lambda t: A.distinct_users_appended(t.events, t.sessions, t.orders)),
        "load_rejects": _q(lambda t: A.load_rejects(t.orders)),
        "monthly_span": _q(lambda t: A.monthly_span(t.orders)),
        "orders_appended": _q(lambda t: A.orders_appended(t.orders)),
    }


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(profile_queries())
    out.update(dashboard_queries())
    out.update(cohort_queries())
    out.update(funnel_queries())
    out.update(revenue_queries())
    out.update(appended_queries())
    return out
