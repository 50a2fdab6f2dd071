"""Rows without a user, as the modelled project's SQL treats them."""

from __future__ import annotations

import datetime as dt

from conftest import make_events, make_items, make_orders, make_products, rows

from shopmetrics.plans import cohort as C
from shopmetrics.plans import dashboard as D
from shopmetrics.plans import funnel as Fn


def test_cart_of_no_user_is_not_bought(spark):
    """A left join on a NULL user matches no order."""
    events = make_events(spark, [(None, "add_to_cart", 7, "2024-01-01 00:00")], session_of=lambda u, ts: 1)
    orders = make_orders(spark, [(1, None, "2024-01-05", 100, 0, "completed")])
    out = rows(Fn.cart_abandonment(events, make_items(spark, ((1, 7),)), orders, make_products(spark)))
    assert [(r[0], r[4], r[5], r[6]) for r in out] == [(7, 1, 0, 1)]


def test_orders_of_no_buyer_are_in_no_cohort(spark):
    orders = make_orders(spark, [(1, None, "2024-01-05", 100, 0, "completed"), (2, 5, "2024-01-06", 10, 0, "completed"),
                                 (3, 5, "2024-03-06", 10, 0, "completed")])
    assert rows(C.cohort_sizes(orders)) == [("2024-01", 1, 1)]
    assert [r[:4] for r in rows(C.cohort_revenue(orders))] == [("2024-01", "2024-01", 0, 1), ("2024-01", "2024-03", 2, 1)]
    assert sorted(r[0] for r in rows(C.cohort_base(orders))) == [2, 3]
    assert rows(C.cohort_span(orders)) == [(1, 2)]
    assert [r[:4] for r in rows(D.retention_lod(orders))] == [("2024-01", 0, 1, 1), ("2024-01", 2, 1, 1)]
    assert dt.date(2024, 1, 1) == rows(C.cohort_activity(orders), "cohort_start")[0][0]
