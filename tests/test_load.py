"""Loads with bad records: every record is a row or a reject, from one scan."""

from __future__ import annotations

import pytest
from conftest import D, M, rows

from shopmetrics.sources import io, load

HEADER = "order_id,session_id,user_id,order_date,total_amount,discount_amount,payment_method,status\n"


def make(tmp_path, *files, header=HEADER):
    (tmp_path / "in").mkdir()
    for i, text in enumerate(files):
        (tmp_path / "in" / f"{i}.csv").write_text(header + text)
    return str(tmp_path / "in"), str(tmp_path / "out")


def test_rows_and_rejects_add_up_to_the_records(spark, tmp_path):
    src, out = make(
        tmp_path,
        '1,11,1,2024-01-05,150.00,0.00,"card, or ""cash""\nlater",completed\n2,11,1,2024-01-06,12x,0.00,card,completed\n3,11,1,,5.00,0.00,card,completed\n',
        "4,11,1,2024-02-30,5.00,0.00,card,completed\n5,11,1,2024-01-05,5.00,0.00,card,lost\n6,11,1\n7,11,1,2024-01-05,5.00,0.00,card,completed,more\n,1,1,2024-01-01,1,0,c,returned\n"
        "8,11,1,2024-01-09,7.5,0.00,card,returned\n")
    done = load.load_csv(spark, src, "orders", out)
    assert (done.accepted, done.rejected) == (2, 7)
    assert sorted(rows(done.rows())) == [(1, 11, 1, D("2024-01-05"), M(150), M(0), 'card, or "cash"\nlater', "completed"),
                                         (8, 11, 1, D("2024-01-09"), M("7.5"), M(0), "card", "returned")]
    assert done.rows().columns == done.schema.names
    assert sorted(rows(done.rejects(), "column", "reason"), key=str) == sorted([
        ("total_amount", "cannot read as decimal(18,2): 12x"), ("order_date", "no value"), ("order_date", "cannot read as date: 2024-02-30"),
        ("status", "not an allowed value: lost"), (None, "not as many fields as the header"), (None, "not as many fields as the header"),
        ("order_id", "no value")], key=str)
    records = {r[0] for r in rows(done.rejects(), "record")}
    assert "6,11,1" in records and "2,11,1,2024-01-06,12x,0.00,card,completed" in records
    # A second load replaces the first.
    assert load.load_csv(spark, src, "orders", out).rejects().count() == 7


def test_one_scan_for_both_sinks(spark, tmp_path):
    src, _ = make(tmp_path, "1,11,1,2024-01-05,150.00,0.00,card,completed\n")
    plan = load.checked(load.read_records(spark, src), "orders")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "Exchange" not in plan and "Python" not in plan


def test_only_good_only_bad_and_no_records(spark, tmp_path):
    src, out = make(tmp_path, "1,11,1,2024-01-05,150.00,0.00,card,completed\n")
    done = load.load_csv(spark, src, "orders", out)
    assert (done.accepted, done.rejected, rows(done.rejects())) == (1, 0, [])
    (tmp_path / "in" / "0.csv").write_text(HEADER + "x,11,1,2024-01-05,150.00,0.00,card,completed\n")
    done = load.load_csv(spark, src, "orders", out)
    assert (done.accepted, done.rejected, rows(done.rows())) == (0, 1, [])
    (tmp_path / "in" / "0.csv").write_text(HEADER)
    done = load.load_csv(spark, src, "orders", out)
    assert (rows(done.rows()), rows(done.rejects())) == ([], [])


def test_other_headers_and_a_missing_column(spark, tmp_path):
    src, out = make(tmp_path, "1,11,1,page_view,,2024-01-01 10:00:00,/\n2,11,1,page_view,7x,2024-01-01 10:00:00,/\n",
                    header="event_id,session_id,user_id,event_type,product_id,timestamp,page\n")
    done = load.load_csv(spark, src, "events", out)
    assert rows(done.rows(), "event_id", "product_id") == [(1, None)] and rows(done.rejects(), "column") == [("product_id",)]
    assert sorted(rows(done.rows())) == sorted(rows(io.read_table(spark, src, "events", "csv", bad_values="null").where("event_id = 1")))
    with pytest.raises(ValueError, match="sessions: no column session_date"):
        load.load_csv(spark, src, "sessions", out)
