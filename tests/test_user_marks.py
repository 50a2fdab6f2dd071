"""Distinct counts from stored user bitmaps."""

from __future__ import annotations

from conftest import D, M, make_events, make_orders, make_sessions, rows
from pyspark.sql import functions as F

from shopmetrics.model import EVENTS, ORDERS
from shopmetrics.operators import bitmaps as B
from shopmetrics.plans import dashboard as Db
from shopmetrics.plans import funnel as Fn
from shopmetrics.plans import user_marks as U


def test_counts_equal_count_distinct(spark):
    df = spark.createDataFrame([(g, x) for g, xs in {"a": [0, 1, 1, 32768, 32769, -1, -40000], "b": [None, None], "c": [2**40, 2**40 + 1, 2**40]}.items()
                                for x in xs], "g string, x long")
    sets = B.bitmaps_of(df, ["g"], "x")
    assert dict(rows(B.members(sets, ["g"], "n"))) == {"a": 6, "b": 0, "c": 2}
    assert rows(B.members(sets.union(sets), [], "n")) == [(8,)]


def test_dense_numbers_keep_earlier_ones(spark):
    first = B.number_keys(spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "k string"), "k")
    assert sorted(r[1] for r in rows(first)) == [1, 2]
    known = spark.createDataFrame(rows(first), "k string, number long")
    both = dict(rows(B.number_keys(spark.createDataFrame([("y",), ("z",), ("w",)], "k string"), "k", known)))
    assert {k: both[k] for k in ("x", "y")} == dict(rows(first)) and sorted(both.values()) == [1, 2, 3, 4]


def test_every_count_from_one_table_and_a_new_day(spark, tmp_path):
    events, sessions, orders = make_events(spark), make_sessions(spark), make_orders(spark)
    more = spark.createDataFrame([(90, 999, 4, "page_view", None, events.first()["ts"], None), (91, 101, None, "purchase", None, events.first()["ts"], None),
                                  (92, 103, 3, "other", None, events.first()["ts"], None)], EVENTS)  # no session, no user, no stage
    events = events.union(more)
    store = U.UserMarks(spark, str(tmp_path))
    cut = "2024-01-02"
    for batch, e, o in (("a", f"ts < '{cut}'", "order_id <= 4"), ("b", f"ts >= '{cut}'", "order_id > 4"), ("b", f"ts >= '{cut}'", "order_id > 4")):
        store.add(events.where(e), sessions, orders.where(o), batch)
    t = store.table()
    assert rows(U.funnel_overall(t)) == rows(Fn.funnel_overall(events))
    assert rows(U.funnel_by(t, "device_type")) == rows(Fn.funnel_by_device(events, sessions).select(*Fn.funnel_by_device(events, sessions).columns))
    assert rows(U.funnel_by(t, "channel")) == rows(Fn.funnel_by_channel(events, sessions))
    assert rows(U.funnel_weekly(t)) == rows(Fn.funnel_weekly(events))
    assert rows(U.kpi_customers(t)) == rows(Db.kpi_customers(orders))
    long = {(r[0], r[1], r[2]): r[3] for r in rows(U.distinct_report(t))}
    assert long[("overall", None, "page_view")] == 4 and long[("customers", None, U.BUYER)] == 3 and ("device_type", "desktop", "purchase") not in long
    # A new day is taken in from its own rows; nothing of the stored days is read.
    day = spark.createDataFrame([(99, 102, 2, "purchase", None, F_ts("2024-02-01 10:00"), None)], EVENTS)
    new = U.marks(day, sessions, spark.createDataFrame([(50, 102, 9, D("2024-02-01"), M(1), M(0), "card", "completed")], ORDERS))
    assert "FileScan" not in new._jdf.queryExecution().executedPlan().toString()
    store.add(day, sessions, spark.createDataFrame([(50, 102, 9, D("2024-02-01"), M(1), M(0), "card", "completed")], ORDERS), "c")
    assert rows(U.funnel_overall(store.table())) == rows(Fn.funnel_overall(events.union(day)))
    assert rows(U.kpi_customers(store.table())) == [(4,)]


def F_ts(text):
    import datetime as dt

    return dt.datetime.fromisoformat(text)


def test_empty(spark, tmp_path):
    t = U.UserMarks(spark, str(tmp_path)).table()
    assert rows(U.kpi_customers(t)) == [(0,)] and rows(U.distinct_report(t)) == []
    assert {n for _, n in rows(U.funnel_overall(t))} == {0}
