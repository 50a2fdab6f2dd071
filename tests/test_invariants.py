
from __future__ import annotations

import os

import pytest
from conftest import SF_SMALL, rows

from shopmetrics.plans import cohort as C
from shopmetrics.plans import funnel as Fn
from shopmetrics.plans import revenue as R
from shopmetrics.sources.adapters import DriverTables

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables not present")


@pytest.fixture(scope="module")
def t(spark):
    return DriverTables(spark, SF_SMALL)


def test_month_zero_retention_is_100(t):
    assert {r[2] for r in rows(C.retention_matrix(t.orders)) if r[1] == 0} == {100.0}


def test_shares_sum_to_100(t):
    shares = [r[4] for r in rows(R.revenue_by_channel(t.orders, t.sessions))]
    assert abs(sum(shares) - 100.0) <= 0.01 * len(shares)
    pct = [r[2] for r in rows(R.orders_per_buyer(t.orders))]
    assert abs(sum(pct) - 100.0) <= 0.01 * len(pct)


def test_ltv_is_non_decreasing(t):
    by_cohort: dict[str, list[float]] = {}
    for c, _, v in rows(C.ltv_curve(t.orders)):
        by_cohort.setdefault(c, []).append(v)
    assert all(a <= b for vs in by_cohort.values() for a, b in zip(vs, vs[1:]))


def test_cohort_sizes_sum_to_buyers(t):
    assert sum(r[1] for r in rows(C.cohort_sizes(t.orders))) == rows(R.repeat_rate(t.orders))[0][0]


def test_cohort_revenue_sums_to_monthly_revenue(t):
    c3 = round(sum(r[4] for r in rows(C.cohort_revenue(t.orders))), 2)
    r1 = round(sum(r[2] for r in rows(R.revenue_monthly(t.orders))), 2)
    assert c3 == r1


def test_sql_and_notebook_routes_agree(t):
    o = t.orders
    c2 = {(r[0], r[5]): r[3] for r in rows(C.cohort_retention(o))}
    c5_users = {(r[0], r[1]): r[2] for r in rows(C.retention_matrix(o))}
    assert c2.keys() == c5_users.keys()
    assert [r[:4] for r in rows(C.cohort_user_value(o))] == rows(C.cohort_engagement(o))
    r1 = {m: rev for m, _, rev, _, _ in rows(R.revenue_monthly(o)) if rev}
    assert r1 == dict(rows(R.revenue_monthly_completed(o)))
    f1 = rows(Fn.funnel_overall(t.events))
    f1p = [r[:2] for r in rows(Fn.funnel_rates(t.events))]
    assert f1 == f1p


def test_funnel_drops_sum_to_first_minus_last(t):
    out = rows(Fn.funnel_rates(t.events))
    assert sum(r[4] for r in out) == out[0][1] - out[-1][1]
