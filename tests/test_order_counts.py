"""Distinct orders of a group (R4, R4p, R5, R5p) by marked lines: any keys, and no map of all lines."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from conftest import make_products, rows
from test_plans import _plan, no_broadcast  # noqa: F401

from shopmetrics.plans import revenue as R


def _tables(spark):
    rng = random.Random(6)
    ids = [*range(1, 41), None]
    # Order 3 stands twice, completed both times; order 4 once completed, once not.
    status = {i: rng.choice(["completed", "cancelled"]) for i in ids} | {3: "completed", 4: "completed"}
    orders = [*status.items(), (3, "completed"), (4, "cancelled")]
    lines = [(rng.choice(ids), k, rng.choice([1, 2, 3, None]), rng.choice([1, 2, None]), rng.choice([None, Decimal("2.5000"), Decimal("0.0001")]))
             for k in range(400)]
    products = make_products(spark, ids=(1, 2, 3))
    items = spark.createDataFrame(lines, "order_id long, line_number int, product_id long, quantity int, unit_price decimal(18,4)")
    return orders, lines, spark.createDataFrame(orders, "order_id long, status string"), products, items.repartition(5)


def _brute(orders, lines):
    done = [o[0] for o in orders if o[1] == "completed" and o[0] is not None]
    return [(line, o) for line in lines for o in done if line[0] == o and line[2] is not None]


def _measures(joined):
    revenue = sum((q * u for (_, _, _, q, u), _ in joined if q is not None and u is not None), Decimal(0))
    return len({o for _, o in joined}), sum(line[3] or 0 for line, _ in joined), float(round(revenue + Decimal("1e-9"), 2))


@pytest.mark.parametrize("broadcast", [True, False])
def test_repeated_and_null_keys(spark, broadcast, request):
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    orders, lines, o, p, i = _tables(spark)
    joined = _brute(orders, lines)
    assert any(len([x for x in joined if x[0][0] == k and x[0][2] == 1]) > 2 for k in (3, 4))
    want = sorted((k, *_measures([x for x in joined if x[0][2] == k])) for k in (1, 2, 3))
    assert sorted(rows(R.top_products(i, p, o), "product_id", "total_orders", "units_sold", "total_revenue")) == want
    names = sorted((f"product {k}", "Phones", "B", *rest) for k, *rest in want)
    assert sorted(rows(R.top_products_by_name(i, p, o))) == names
    total = _measures(joined)
    [r4] = rows(R.revenue_by_subcategory(i, p, o))
    assert r4[:4] == ("Phones", *total)
    [r4p] = rows(R.revenue_by_subcategory_margin(i, p, o))
    assert r4p[:4] == ("Phones", *total)


def test_no_map_holds_a_row_of_each_line(spark, no_broadcast):  # noqa: F811
    """The task that joins the lines neither sorts them for that nor groups them by order."""
    _, _, o, p, i = _tables(spark)
    for f in (R.top_products, R.top_products_by_name, R.revenue_by_subcategory, R.revenue_by_subcategory_margin):
        text = _plan(f(i, p, o))
        grouped = [line for line in text.splitlines() if "HashAggregate(keys=" in line or "SortAggregate(key=" in line]
        assert grouped and not [line for line in grouped if "order_id" in line.split("functions")[0]], f.__name__
        joins = [line for line in text.splitlines() if "Join [order_id" in line]
        assert joins and all("ShuffledHashJoin" in line for line in joins), f.__name__
