"""Level-of-detail expressions, month pruning, runtime filters and the one-scan histogram: results and plans."""

from __future__ import annotations

import re

import pytest
from conftest import D, M, make_events, make_orders, make_products, make_users, rows
from pyspark.sql import functions as F

from shopmetrics.model import ORDERS
from shopmetrics.operators.lod import Computed, Fixed, view, with_fixed
from shopmetrics.plans import cohort as C
from shopmetrics.plans import dashboard as Db
from shopmetrics.plans import funnel as Fn
from shopmetrics.plans import profile as P
from shopmetrics.plans import revenue as R
from shopmetrics.session import runtime_filters
from shopmetrics.sources import io, monthly


def plan(df, final=False):
    if final:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_fixed_is_before_the_filter_and_after_the_context(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "x"), (None, 7, "x"), (None, 8, "y"), ("b", 100, "z")], "g string, v long, s string")
    steps = [Fixed("whole", ["g"], F.sum("v")), Computed("part", F.col("v") / F.col("whole")), Fixed("top", [], F.max("whole"))]
    out = view(df, steps, ["g"], {"v": F.sum("v"), "whole": F.min("whole"), "top": F.max("top"), "part": F.sum("part")},
               where=F.col("s") == "x", context=F.col("s") != "z")
    assert sorted(rows(out), key=str) == sorted([("a", 1, 3, 15, 1 / 3), ("b", 5, 5, 15, 1.0), (None, 7, 15, 15, 7 / 15)], key=str)


def test_fixed_keeps_repeated_rows_and_spreads_a_hot_value(spark):
    df = spark.createDataFrame([(1, i % 50) for i in range(3000)] + [(2, 1), (2, 1)], "k long, v long")
    out = with_fixed(df, Fixed("n", ["k"], F.count(F.lit(1))))
    assert out.count() == 3002 and {(r["k"], r["n"]) for r in out.select("k", "n").distinct().collect()} == {(1, 3000), (2, 2)}
    spread = df.where("k = 1").select(F.pmod(F.hash("k", "v"), F.lit(16)).alias("s")).groupBy("s").count().collect()
    assert len(spread) > 8


def test_retention_and_channel_shares(spark):
    orders, users = make_orders(spark), make_users(spark)
    assert sorted(rows(Db.retention_fixed(orders))) == sorted(rows(Db.retention_lod(orders)))
    whole = {r[1]: r[3] for r in rows(Db.channel_payment_share(orders, users))}
    assert whole == {"card": 560.0}
    since = {r[1]: (r[2], r[3]) for r in rows(Db.channel_payment_share(orders, users, context=F.col("order_date") >= "2024-02-01"))}
    assert since == {"card": (80.0, 250.0)}


@pytest.fixture()
def stored(spark, tmp_path):
    orders = make_orders(spark).union(spark.createDataFrame([(50, 1, 1, None, M(5), M(0), "card", "completed")], ORDERS))
    monthly.write_monthly(orders, "orders", str(tmp_path / "orders"))
    monthly.write_monthly(make_events(spark), "events", str(tmp_path / "events"))
    return orders, str(tmp_path)


def test_a_span_of_two_months_reads_two_folders(spark, stored):
    orders, root = stored
    part = monthly.read_span(spark, "orders", f"{root}/orders", "2024-01-10", "2024-02-20")
    kept = orders.where("order_date between '2024-01-10' and '2024-02-20'")
    assert sorted(rows(part)) == sorted(rows(kept)) and part.columns == ORDERS.names
    files = {re.search("month_key=([^/]*)/", r[0])[1] for r in part.select(F.input_file_name()).distinct().collect()}
    assert files == {"2024-01", "2024-02"}
    for df, fresh in ((R.revenue_monthly(part), R.revenue_monthly(kept)), (C.cohort_retention(part), C.cohort_retention(kept))):
        filters = plan(df).split("PartitionFilters: [")[1].split("]")[0]
        assert "month_key" in filters and "2024-01" in filters and "2024-02" in filters
        assert sorted(rows(df)) == sorted(rows(fresh))
    week = Fn.funnel_weekly(monthly.read_span(spark, "events", f"{root}/events", "2024-01-01", "2024-02-28"))
    assert "month_key" in plan(week).split("PartitionFilters: [")[1].split("]")[0]
    assert rows(week) == rows(Fn.funnel_weekly(make_events(spark).where("ts >= '2024-01-01'")))


def test_open_spans_and_rows_without_a_date(spark, stored):
    orders, root = stored
    path = f"{root}/orders"
    assert monthly.read_span(spark, "orders", path).count() == orders.count()
    assert monthly.read_span(spark, "orders", path, first="2024-03-05").count() == orders.where("order_date >= '2024-03-05'").count()
    assert monthly.read_span(spark, "orders", path, last=D("2024-01-20")).count() == orders.where("order_date <= '2024-01-20'").count()


def test_runtime_filters_thin_the_lines(spark, tmp_path):
    orders = spark.range(4000).select(F.col("id").alias("order_id"), F.col("id").alias("session_id"), F.col("id").alias("user_id"), F.lit(D("2024-01-01")).alias("order_date"),
                                      F.lit(M(1)).alias("total_amount"), F.lit(M(0)).alias("discount_amount"), F.lit("card").alias("payment_method"),
                                      F.when(F.col("id") % 20 == 0, "completed").otherwise("cancelled").alias("status"))
    lines = spark.range(8000).select((F.col("id") % 4000).alias("order_id"), F.col("id").cast("int").alias("line_number"), (7 + F.col("id") % 2).alias("product_id"),
                                     F.lit(1).alias("quantity"), F.lit(M(1)).cast("decimal(18,4)").alias("unit_price"))
    io.write_tables({"orders": orders, "order_items": lines, "products": make_products(spark)}, str(tmp_path))
    t = {n: io.read_table(spark, str(tmp_path / n), n) for n in ("orders", "order_items", "products")}
    fns = (R.revenue_by_subcategory, R.top_products, R.top_products_by_name)
    plainly = [rows(f(t["order_items"], t["products"], t["orders"])) for f in fns]
    own = {k: spark.conf.get(k, None) for k in ["spark.sql.autoBroadcastJoinThreshold", *(
        f"spark.sql.optimizer.runtime.bloomFilter.{k}" for k in ("enabled", "expectedNumItems", "maxNumItems", "numBits", "maxNumBits",
                                                                 "creationSideThreshold", "applicationSideScanSizeThreshold"))]}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        runtime_filters(spark, keys=4000)
        for f, want in zip(fns, plainly):
            df = f(t["order_items"], t["products"], t["orders"])
            assert "might_contain" in plan(df) and rows(df) == want
        # The rows that pass the filter are what the shuffle gets: a twentieth of the lines and a few false positives.
        both = t["order_items"].join(t["orders"].where("status = 'completed'").select("order_id"), "order_id")
        text = plan(both, final=True)
        assert "might_contain" in text and both.count() == 400
    finally:
        for k, v in own.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_status_filter_reaches_the_scan_of_the_driver_orders(spark):
    from shopmetrics.sources.adapters import driver_tables

    text = plan(Db.kpi_orders(driver_tables(spark, "/root/testdata/sf0.001").orders))
    assert "PushedFilters: [EqualNullSafe(o_orderstatus,F)]" in text


def test_histogram_scans_once_and_runs_nothing_when_built(spark, tmp_path):
    io.write_table(make_orders(spark), str(tmp_path / "orders"))
    orders = io.read_table(spark, str(tmp_path / "orders"), "orders")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("histogram build", "")
    try:
        df = P.order_value_histogram(orders)
        assert list(tracker.getJobIdsForGroup("histogram build")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    text = plan(df, final=True)
    assert "ReusedExchange" in text and "Subquery" in text  # the range comes from the exchange of the counts
    assert sum(r["count"] for r in df.collect()) == 4
    empty = P.order_value_histogram(orders.where("order_id < 0")).collect()
    assert len(empty) == 40 and all((r["lo"], r["count"], r["mean_order_value"]) == (None, 0, None) for r in empty)
