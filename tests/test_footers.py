"""Figures from Parquet footers: equal to those from rows, and no row is read."""

from __future__ import annotations

from conftest import make_events, make_items, make_orders, make_products, make_sessions, make_users, rows

from shopmetrics.plans import profile as P
from shopmetrics.sources import footers, io


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_nulls_and_ranges_from_footers(spark, tmp_path):
    tables = {"users": make_users(spark), "products": make_products(spark), "sessions": make_sessions(spark),
              "events": make_events(spark), "orders": make_orders(spark), "order_items": make_items(spark)}
    io.write_tables(tables, str(tmp_path))
    paths = {t: str(tmp_path / t) for t in tables}
    back = io.read_tables(spark, str(tmp_path))
    counts, nulls = footers.row_counts(spark, paths), footers.null_counts(spark, paths)
    dates = footers.ranges(spark, {"sessions": (paths["sessions"], "session_date"), "orders": (paths["orders"], "order_date")})
    for df, n in ((counts, 6), (nulls, 6), (dates, 2)):
        text = plan(df)
        assert text.count("PushedAggregation: [") == n and "PushedAggregation: []" not in text
        # What the scan returns is the aggregates, not the columns of the table.
        assert "order_id:bigint" not in text and "ReadSchema: struct<>" not in text
    assert sorted(rows(counts)) == sorted(rows(P.table_profile(back)))
    assert sorted(rows(nulls)) == sorted(rows(P.null_profile(back)))
    assert sorted(rows(dates)) == sorted(rows(P.date_ranges(back["sessions"], back["orders"])))


def test_other_queries_keep_their_reader(spark, tmp_path):
    io.write_table(make_orders(spark), str(tmp_path / "orders"))
    footers.row_counts(spark, {"orders": str(tmp_path / "orders")}).collect()
    assert "FileScan parquet" in plan(spark.read.parquet(str(tmp_path / "orders")).where("order_id = 1"))


def test_an_empty_table(spark, tmp_path):
    io.write_table(make_orders(spark).limit(0), str(tmp_path / "orders"))
    assert rows(footers.row_counts(spark, {"orders": str(tmp_path / "orders")})) == [("orders", 0, 8)]
    assert rows(footers.ranges(spark, {"orders": (str(tmp_path / "orders"), "order_date")})) == [("orders", "order_date", None, None)]
