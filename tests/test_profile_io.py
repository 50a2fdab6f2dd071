from __future__ import annotations

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import SF_SMALL, make_events, make_items, make_orders, make_products, make_sessions, make_users, rows

from shopmetrics.operators.aggregates import equal_width_histogram
from shopmetrics.plans import profile as P
from shopmetrics.sources import io
from shopmetrics.sources.adapters import DriverTables


def _tables(spark):
    return {"users": make_users(spark), "products": make_products(spark), "sessions": make_sessions(spark),
            "events": make_events(spark), "orders": make_orders(spark), "order_items": make_items(spark)}


def test_duplicates_count_null_as_a_value(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k long")
    assert rows(P.Q.duplicate_count(df, ["k"])) == [(2,)]


@pytest.mark.parametrize("bins", [5, 30])
def test_histogram_matches_numpy(spark, bins):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.uniform(0, 97.3, 500), [0.0, 97.3, 48.65]])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    out = rows(equal_width_histogram(df, "v", bins).orderBy("bin"))
    counts, edges = np.histogram(vals, bins=bins)
    assert [r[3] for r in out] == counts.tolist()
    assert np.allclose([r[1] for r in out], edges[:-1]) and out[-1][2] == edges[-1]


def test_histogram_degenerate_range(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    out = rows(equal_width_histogram(df, "v", 4).orderBy("bin"))
    counts, _ = np.histogram([5.0, 5.0], bins=4)
    assert [r[3] for r in out] == counts.tolist()


def test_rule_violations_find_orphans_and_bad_values(spark):
    t = _tables(spark)
    out = dict(rows(P.rule_violations(t)))
    # items reference orders 1 and 4, both present; events reference sessions 101..103
    assert out["foreign_key:order_items.order_id->orders.order_id"] == 0
    # orders' sessions 1..8 are not in the sessions fixture
    assert out["foreign_key:orders.session_id->sessions.session_id"] == 8
    assert out["check:events.event_type"] == 0
    assert out["not_null:users.signup_date"] == 4
    assert out["primary_key_unique:orders(order_id)"] == 0


def test_null_profile_and_table_profile(spark):
    t = _tables(spark)
    prof = {r[0]: r[1:] for r in rows(P.table_profile(t))}
    assert prof["orders"] == (8, 8) and prof["events"] == (12, 7)
    nulls = {(r[0], r[1]): r[2:] for r in rows(P.null_profile(t))}
    assert nulls[("events", "product_id")] == (6, 50.0)
    assert ("orders", "order_id") not in nulls


def test_csv_and_parquet_round_trip(spark):
    o = make_orders(spark)
    e = make_events(spark).withColumn("ts", F.expr("ts + make_dt_interval(0, 0, 0, 7.179575)"))
    root = tempfile.mkdtemp(prefix="shopmetrics-io-")
    for fmt in ("csv", "parquet"):
        io.write_tables({"orders": o, "events": e}, os.path.join(root, fmt), fmt)
        back_o = io.read_table(spark, os.path.join(root, fmt, "orders"), "orders", fmt)
        back_e = io.read_table(spark, os.path.join(root, fmt, "events"), "events", fmt)
        assert sorted(rows(back_o)) == sorted(rows(o))
        assert sorted(rows(back_e)) == sorted(rows(e))
    io.write_table(o, os.path.join(root, "parquet", "orders"), "parquet", mode="append")
    assert io.read_table(spark, os.path.join(root, "parquet", "orders"), "orders").count() == 16


PRODUCTS_CSV = """product_id,product_name,category,subcategory,brand,price,cost,stock_quantity
1,Alpha 13,Electronics,Laptops,North,999.99,700.00,5
2,Alpha 15,Electronics,Laptops,North,1399.01,901.50,0
3,Beam,Electronics,TVs,South,450.00,300.25,7
4,"Cable, long",Electronics,Accessories,South,9.95,1.10,120
"""


def test_products_csv(spark):
    """A file with the header of the product export."""
    path = os.path.join(tempfile.mkdtemp(prefix="shopmetrics-csv-"), "products.csv")
    with open(path, "w") as fh:
        fh.write(PRODUCTS_CSV)
    p = io.read_table(spark, path, "products", "csv")
    assert dict(rows(P.products_per_subcategory(p))) == {"Laptops": 2, "TVs": 1, "Accessories": 1}
    assert dict(rows(P.avg_price_by_subcategory(p))) == {"Laptops": 1199.5, "TVs": 450.0, "Accessories": 9.95}
    hist = rows(P.price_histogram(p))
    counts, _ = np.histogram([999.99, 1399.01, 450.0, 9.95], bins=30)
    assert [r[3] for r in sorted(hist)] == counts.tolist()
    assert rows(p.where("product_id = 4"), "product_name", "stock_quantity") == [("Cable, long", 120)]


@pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables not present")
def test_driver_adapter_invariants(spark):
    t = DriverTables(spark, SF_SMALL)
    sess = t.sessions
    assert sess.count() == sess.select("session_id").distinct().count()
    # every event session and every order session exists
    out = dict(rows(P.rule_violations(t.as_dict())))
    assert out["foreign_key:events.session_id->sessions.session_id"] == 0
    assert out["foreign_key:orders.session_id->sessions.session_id"] == 0
    assert out["check:orders.status"] == 0


def test_export_enriched_orders_and_read_tables_back(spark):
    from shopmetrics.plans import dashboard as D

    root = tempfile.mkdtemp(prefix="shopmetrics-export-")
    t = _tables(spark)
    io.write_tables(t, root, "parquet")
    back = io.read_tables(spark, root, "parquet")
    assert {n: df.count() for n, df in back.items()} == {n: df.count() for n, df in t.items()}
    D.write_orders_enriched(back["orders"], back["sessions"], back["users"], os.path.join(root, "x1"), "csv")
    x1 = spark.read.option("header", True).csv(os.path.join(root, "x1"))
    assert x1.count() == 8 and "acquisition_channel" in x1.columns


def test_bucketed_orders_need_no_shuffle_for_per_user_work(spark):
    from shopmetrics.plans import cohort as C

    root = tempfile.mkdtemp(prefix="shopmetrics-bucket-")
    orders = io.write_bucketed(make_orders(spark), "shopmetrics_test_orders", os.path.join(root, "orders"),
                               "user_id", 4)
    activity = C.cohort_activity(orders)
    plan = activity._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan            # per-(user, month) aggregate and per-user window in place
    assert sorted(rows(C.cohort_retention(orders))) == sorted(rows(C.cohort_retention(make_orders(spark))))
    spark.sql("DROP TABLE IF EXISTS shopmetrics_test_orders")
