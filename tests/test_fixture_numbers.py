"""The checked numbers of FIXTURES.md §3 (driver tables at sf0.01 through the adapter)."""

from __future__ import annotations

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shopmetrics.plans import cohort as C
from shopmetrics.plans import funnel as Fn
from shopmetrics.plans import revenue as R
from shopmetrics.sources.adapters import DriverTables

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def t(spark):
    return DriverTables(spark, SF)


def test_sessions(t):
    assert t.sessions.count() == 19006
    assert t.sessions.select("session_id").distinct().count() == 19006
    assert t.sessions.select("channel", "device_type").distinct().count() == 18


def test_funnel_numbers(t):
    assert dict(rows(Fn.funnel_by_device(t.events, t.sessions), "device_type", "page_view_users")) == \
        {"mobile": 149, "desktop": 147, "tablet": 148}
    weekly = rows(Fn.funnel_weekly(t.events), "week", "page_view_users")
    assert [n for w, n in weekly if w.startswith("2024-W0")] == [139, 145, 140, 143, 101]
    assert {n for _, n in rows(Fn.funnel_overall(t.events))} == {150}
    ab = Fn.cart_abandonment(t.events, t.order_items, t.orders, t.products, k=1_000_000)
    assert rows(ab.agg(F.sum("cart_adds"), F.sum("purchases"))) == [(1882, 10)]


def test_revenue_and_cohort_numbers(t):
    assert dict(rows(R.discount_impact(t.orders), "discount_group", "total_orders")) == \
        {"No Discount": 1383, "With Discount": 3550}
    assert C.cohort_sizes(t.orders).count() == 79
    assert t.products.select("product_name").distinct().count() == 64
