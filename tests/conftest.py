from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shopmetrics.model import EVENTS, ORDER_ITEMS, ORDERS, PRODUCTS, SESSIONS, USERS  # noqa: E402
from shopmetrics.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="shopmetrics-tests")
    yield s


def D(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def M(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


# Hand fixture of FIXTURES.md §4: (order_id, user_id, order_date, total, discount, status)
ORDER_ROWS = [
    (1, 1, "2024-01-05", 100, 0, "completed"),
    (2, 1, "2024-03-10", 50, 5, "completed"),
    (3, 2, "2024-01-20", 200, 0, "completed"),
    (4, 2, "2024-02-01", 80, 10, "cancelled"),
    (5, 3, "2024-02-15", 30, 0, "completed"),
    (6, 3, "2024-03-01", 70, 0, "returned"),
    (7, 4, "2024-04-02", 20, 0, "cancelled"),
    (8, 3, "2024-01-31", 10, 0, "cancelled"),
]

# (user, type, product, ts)
EVENT_ROWS = [
    (1, "page_view", None, "2023-12-31 23:00"),
    (1, "page_view", None, "2024-01-01 00:00"),
    (1, "product_view", 7, "2024-01-01 00:01"),
    (1, "add_to_cart", 7, "2024-01-01 00:02"),
    (1, "checkout_start", None, "2024-01-01 00:03"),
    (1, "purchase", None, "2024-01-01 00:04"),
    (2, "page_view", None, "2024-01-02 10:00"),
    (2, "product_view", 7, "2024-01-02 10:01"),
    (2, "add_to_cart", 7, "2024-01-02 10:02"),
    (2, "add_to_cart", 8, "2024-01-02 10:02"),
    (2, "add_to_cart", 7, "2024-01-09 10:02"),
    (3, "page_view", None, "2024-01-09 10:00"),
]


def make_orders(spark, rows=ORDER_ROWS):
    data = [(oid, oid, uid, D(d), M(t), M(disc), "card", st) for oid, uid, d, t, disc, st in rows]
    return spark.createDataFrame(data, ORDERS)


def make_events(spark, rows=EVENT_ROWS, session_of=None):
    data = []
    for i, (u, typ, prod, ts) in enumerate(rows):
        sid = session_of(u, ts) if session_of else 100 + u
        data.append((i + 1, sid, u, typ, prod, dt.datetime.fromisoformat(ts), None))
    return spark.createDataFrame(data, EVENTS)


def make_users(spark, ages=None):
    ages = ages or {1: "18-24", 2: "25-34", 3: "18-24", 4: "55+"}
    data = [(u, None, "US", "mobile", "email", a, None) for u, a in ages.items()]
    return spark.createDataFrame(data, USERS)


def make_sessions(spark, devices=None):
    devices = devices or {101: ("mobile", "email"), 102: ("desktop", "direct"), 103: ("mobile", "direct")}
    data = [(sid, sid - 100, D("2024-01-01"), 10, dev, ch, None) for sid, (dev, ch) in devices.items()]
    return spark.createDataFrame(data, SESSIONS)


def make_products(spark, ids=(7, 8)):
    data = [(p, f"product {p}", "Electronics", "Phones", "B", M(10 * p), M(5 * p), None) for p in ids]
    return spark.createDataFrame(data, PRODUCTS)


def make_items(spark, rows=((1, 7), (4, 7))):
    data = [(o, i + 1, p, 1, Decimal("10.0000")) for i, (o, p) in enumerate(rows)]
    return spark.createDataFrame(data, ORDER_ITEMS)


def rows(df, *cols):
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.collect()]
