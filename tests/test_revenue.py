from __future__ import annotations

from conftest import make_items, make_orders, make_products, make_sessions, rows

from shopmetrics.plans import revenue as R


def test_r1_monthly_keeps_months_without_completed_orders(spark):
    out = rows(R.revenue_monthly(make_orders(spark)))
    assert out == [
        ("2024-01", 2, 300.0, 150.0, 0.0),
        ("2024-02", 1, 30.0, 30.0, 0.0),
        ("2024-03", 1, 50.0, 50.0, 5.0),
        ("2024-04", 0, 0.0, None, 0.0),
    ]


def test_r1e_completed_only_agrees_with_r1(spark):
    o = make_orders(spark)
    r1 = {m: rev for m, _, rev, _, _ in rows(R.revenue_monthly(o)) if rev}
    r1e = dict(rows(R.revenue_monthly_completed(o)))
    assert r1 == r1e


def test_r6_discount_impact(spark):
    out = {r[0]: r[1:] for r in rows(R.discount_impact(make_orders(spark)))}
    assert out["No Discount"] == (3, 110.0, 330.0, 0.0, 0.0)
    assert out["With Discount"] == (1, 50.0, 50.0, 5.0, 9.09)


def test_r6b_monthly_discounts_drop_months_without_completed(spark):
    out = rows(R.discount_monthly(make_orders(spark)))
    assert out == [
        ("2024-01", 2, 0, 0.0, 0.0, 300.0),
        ("2024-02", 1, 0, 0.0, 0.0, 30.0),
        ("2024-03", 1, 1, 100.0, 5.0, 50.0),
    ]


def test_r7_repeat_rate(spark):
    assert rows(R.repeat_rate(make_orders(spark))) == [(3, 2, 1, 33.33, 1.33)]


def test_r7b_orders_per_buyer_shares_sum_to_100(spark):
    out = rows(R.orders_per_buyer(make_orders(spark)))
    assert out == [(1, 2, 66.67), (2, 1, 33.33)]


def test_r2_share_of_total_and_zero_revenue_groups(spark):
    sessions = spark.createDataFrame(
        [(i, 1, None, None, "mobile", "email" if i <= 3 else "direct", None) for i in range(1, 9)],
        "session_id long, user_id long, session_date date, session_hour int, device_type string, channel string,"
        " landing_page string")
    out = {r[0]: r[1:] for r in rows(R.revenue_by_channel(make_orders(spark), sessions))}
    assert out["email"] == (3, 350.0, 116.67, 92.11)
    assert out["direct"] == (1, 30.0, 30.0, 7.89)


def test_r4_r5_lines_of_completed_orders_only(spark):
    o, p, i = make_orders(spark), make_products(spark), make_items(spark)
    r4 = rows(R.revenue_by_subcategory(i, p, o))
    # only order 1 is completed: one line, quantity 1 at 10.00, cost 35.00
    assert r4 == [("Phones", 1, 1, 10.0, 10.0, -25.0)]
    r5 = rows(R.top_products(i, p, o, k=10))
    assert r5 == [(7, "product 7", "Phones", "B", 70.0, 1, 1, 10.0, 10.0)]


def test_top_k_breaks_ties_by_key(spark):
    o = make_orders(spark, [(1, 1, "2024-01-05", 10, 0, "completed")])
    p = make_products(spark, ids=(3, 1, 2))
    i = make_items(spark, rows=((1, 3), (1, 1), (1, 2)))
    out = rows(R.top_products(i, p, o, k=2), "product_id")
    assert out == [(1,), (2,)]
    assert make_sessions(spark).count() == 3


def test_grain_parameter(spark):
    o = make_orders(spark)
    weekly = rows(R.revenue_monthly(o, grain="week"))
    assert weekly[0] == ("2024-W01", 1, 100.0, 100.0, 0.0)
    assert sum(r[2] for r in weekly) == 380.0
    moy = rows(R.revenue_monthly_completed(o, grain="month_of_year"))
    assert moy == [(1, 300.0), (2, 30.0), (3, 50.0)]


def test_notebook_variants(spark):
    o, p, i = make_orders(spark), make_products(spark), make_items(spark)
    assert rows(R.revenue_by_subcategory_margin(i, p, o)) == [("Phones", 1, 1, 10.0, -25.0, -250.0)]
    assert rows(R.top_products_by_name(i, p, o)) == [("product 7", "Phones", "B", 1, 1, 10.0)]
    assert rows(R.discount_trend(o)) == [("2024-01", 0.0, 0.0), ("2024-02", 0.0, 0.0), ("2024-03", 100.0, 5.0)]
    assert rows(R.orders_per_buyer(o, first=1)) == [(1, 2, 66.67)]


def test_rounded_share_variant(spark):
    sessions = spark.createDataFrame(
        [(i, 1, None, None, "mobile" if i % 2 else "desktop", "email", None) for i in range(1, 9)],
        "session_id long, user_id long, session_date date, session_hour int, device_type string, channel string,"
        " landing_page string")
    out = {r[0]: r for r in rows(R.revenue_by_session_dim(make_orders(spark), sessions, "device_type",
                                                          share="rounded"))}
    # mobile: orders 1, 3, 5 (completed) = 330; desktop: order 2 = 50
    assert out["mobile"][1:] == (3, 330.0, 110.0, 86.8)
    assert out["desktop"][1:] == (1, 50.0, 50.0, 13.2)
