"""Dashboard measures on the hand fixture of FIXTURES.md §4."""

from __future__ import annotations

from conftest import make_events, make_orders, make_sessions, make_users, rows

from shopmetrics.plans import dashboard as D


def test_kpis(spark):
    o = make_orders(spark)
    assert rows(D.kpi_orders(o)) == [(4,)]
    assert rows(D.kpi_revenue(o)) == [(380.0,)]
    assert rows(D.kpi_customers(o)) == [(3,)]
    assert rows(D.kpi_aov(o)) == [(95.0,)]
    assert rows(D.kpi_repeat_rate(o)) == [(3, 1, 1 / 3)]
    assert rows(D.kpi_conversion(make_events(spark))) == [(1, 4, 0.25)]


def test_month_part_trend_and_unfiltered_sheets(spark):
    o = make_orders(spark)
    assert rows(D.trend_month_part(o)) == [(1, 300.0, 150.0), (2, 30.0, 30.0), (3, 50.0, 50.0)]
    assert rows(D.revenue_by_payment(o)) == [("card", 560.0)]      # every status counts


def test_enriched_orders_keep_every_order(spark):
    o, s, u = make_orders(spark), make_sessions(spark), make_users(spark)
    x1 = D.orders_enriched(o, s, u)
    assert x1.count() == 8
    assert dict(rows(D.revenue_by_country(o, u))) == {"US": 560.0}
    by_channel = rows(D.revenue_by_acq_channel(o, u))
    assert by_channel == [("email", 380.0, 95.0, 380.0)]           # completed only; one channel = its own mean
    # orders' sessions 1..8 are unknown to the session fixture: device is NULL, revenue kept
    assert rows(D.revenue_by_device_all(o, s)) == [(None, 560.0)]
