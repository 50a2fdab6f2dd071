from __future__ import annotations

import datetime as dt

from conftest import EVENT_ROWS, make_events, make_items, make_orders, make_products, make_sessions, make_users, rows
from pyspark.sql import functions as F

from shopmetrics.functions.exprs import monday_week_key
from shopmetrics.plans import funnel as Fn


def test_f1_overall(spark):
    out = rows(Fn.funnel_overall(make_events(spark)))
    assert out == [("page_view", 3), ("product_view", 2), ("add_to_cart", 2), ("checkout_start", 1),
                   ("purchase", 1)]


def test_f2_transitions(spark):
    out = rows(Fn.funnel_transitions(make_events(spark)))
    assert [r[1:] for r in out] == [(3, 2, 66.67, 33.33), (2, 2, 100.0, 0.0), (2, 1, 50.0, 50.0), (1, 1, 100.0, 0.0)]
    assert out[0][0] == "page_view → product_view"


def test_missing_stage_is_zero_in_sql_form_and_null_in_reindex_form(spark):
    ev = make_events(spark, [r for r in EVENT_ROWS if r[1] != "checkout_start"])
    f1 = dict(rows(Fn.funnel_overall(ev)))
    assert f1["checkout_start"] == 0
    f1p = {r[0]: r[1:] for r in rows(Fn.funnel_rates(ev))}
    assert f1p["checkout_start"][0] is None
    assert f1p["page_view"] == (3, 100.0, 0.0, 0)
    assert f1p["product_view"] == (2, 66.67, 33.33, 1)


def test_f1p_drops_sum_to_first_minus_last(spark):
    out = rows(Fn.funnel_rates(make_events(spark)))
    assert sum(r[4] for r in out) == out[0][1] - out[-1][1]


def test_f5_monday_weeks(spark):
    out = rows(Fn.funnel_weekly(make_events(spark)))
    assert out == [("2023-W52", 1, 0, 0, 0, 0), ("2024-W01", 2, 2, 2, 1, 1), ("2024-W02", 1, 0, 1, 0, 0)]


def test_week_key_edges(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2021, 1, 3),), (dt.date(2024, 12, 31),)], "d date")
    assert [r[0] for r in df.select(monday_week_key(F.col("d"))).collect()] == ["2023-W00", "2021-W00", "2024-W53"]


def test_f6_abandonment(spark):
    out = rows(Fn.cart_abandonment(make_events(spark), make_items(spark), make_orders(spark), make_products(spark)))
    assert out == [(8, "product 8", "Phones", 80.0, 1, 0, 1, 100.0), (7, "product 7", "Phones", 70.0, 2, 1, 1, 50.0)]


def test_f3_users_counted_in_every_group(spark):
    # user 1's events in two sessions of different devices count once in each
    def session_of(u, ts):
        return 101 if (u == 1 and ts < "2024-01-01 00:02") else 100 + u + (2 if u == 1 else 0)
    ev = make_events(spark, session_of=session_of)
    sess = make_sessions(spark)
    out = {r[0]: r[1:] for r in rows(Fn.funnel_by_device(ev, sess))}
    # mobile sessions: 101 (user 1 early events) and 103 (user 1 late, user 3)
    assert out["mobile"][:5] == (2, 1, 1, 1, 1)
    assert out["desktop"] == (1, 1, 1, 0, 0, 0.0)


def test_f7_by_age(spark):
    out = rows(Fn.funnel_by_age(make_events(spark), make_users(spark)))
    assert out == [("18-24", 2, 1, 50.0), ("25-34", 1, 0, 0.0)]


def test_no_expand_in_stage_counts(spark):
    plan = Fn.funnel_by_device(make_events(spark), make_sessions(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_funnel_report_equals_individual_metrics(spark):
    ev, sess, users = make_events(spark), make_sessions(spark), make_users(spark)
    report = Fn.funnel_report(ev, sess, users)
    single = {
        "funnel_overall": Fn.funnel_overall(ev), "funnel_rates": Fn.funnel_rates(ev),
        "funnel_share_of_max": Fn.funnel_share_of_max(ev), "funnel_transitions": Fn.funnel_transitions(ev),
        "funnel_by_device": Fn.funnel_by_device(ev, sess), "funnel_by_channel": Fn.funnel_by_channel(ev, sess),
        "funnel_by_device_nb": Fn.funnel_by_dimension(ev, sess, "device_type", style="nb"),
        "funnel_by_channel_nb": Fn.funnel_by_dimension(ev, sess, "channel", style="nb"),
        "funnel_by_device_long": Fn.funnel_by_device_long(ev, sess), "funnel_by_age": Fn.funnel_by_age(ev, users),
    }
    assert set(report) == set(single)
    for name, df in report.items():
        assert sorted(rows(df)) == sorted(rows(single[name])), name


def test_funnel_report_counts_events_without_a_known_session_overall_only(spark):
    ev = make_events(spark, session_of=lambda u, ts: 555 if u == 3 else 100 + u)
    sess, users = make_sessions(spark), make_users(spark)
    report = Fn.funnel_report(ev, sess, users)
    assert rows(report["funnel_overall"]) == rows(Fn.funnel_overall(ev))
    assert dict(rows(report["funnel_overall"]))["page_view"] == 3
    assert sorted(rows(report["funnel_by_device"])) == sorted(rows(Fn.funnel_by_device(ev, sess)))
    assert sum(r[1] for r in rows(report["funnel_by_device"])) == 2


def test_transition_from_an_empty_stage_is_null_not_an_error(spark):
    ev = make_events(spark, [r for r in EVENT_ROWS if r[1] != "add_to_cart"])
    out = {r[0]: r[1:] for r in rows(Fn.funnel_transitions(ev))}
    assert out["add_to_cart → checkout_start"] == (0, 1, None, None)
    assert out["product_view → add_to_cart"] == (2, 0, 0.0, 100.0)
