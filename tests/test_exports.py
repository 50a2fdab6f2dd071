"""Reading exported files with the modelled project's own headers, and what a bad source does."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.errors import PySparkException
from test_random_differential import make_driver_tables

from shopmetrics.plans import dashboard as D
from shopmetrics.plans import funnel as Fn
from shopmetrics.plans import profile as P
from shopmetrics.sources import io
from shopmetrics.sources.adapters import DriverTables

FILES = {
    "users": "user_id,signup_date,country,device_type,acquisition_channel,age_group,email\n"
             "1,2024-01-01,US,mobile,email,18-24,a@x\n2,2024-01-02,DE,desktop,direct,25-34,b@x\n",
    "products": "product_id,product_name,category,subcategory,brand,price,cost,stock_quantity\n"
                "7,P7,Electronics,Phones,B,70.00,35.00,4\n8,P8,Electronics,Phones,B,80.00,40.00,4\n",
    "sessions": "session_id,user_id,session_date,session_hour,device_type,channel,landing_page\n"
                "11,1,2024-01-01,10,mobile,email,/\n12,2,2024-01-08,11,desktop,direct,/\n",
    "events": "event_id,session_id,user_id,event_type,product_id,timestamp,page\n"
              "1,11,1,page_view,,2024-01-01 10:00:00,/\n2,11,1,add_to_cart,7,2024-01-01 10:01:00,/p\n"
              "3,12,2,page_view,,2024-01-08 11:00:00,/\n",
    "orders": "order_id,session_id,user_id,order_date,total_amount,discount_amount,payment_method,status\n"
              "21,11,1,2024-01-01,150.00,0.00,card,completed\n",
    "order_items": "item_id,order_id,product_id,quantity,unit_price\n31,21,7,1,70.00\n32,21,8,1,80.00\n33,21,7,1,70.00\n",
}


@pytest.fixture()
def exported(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.csv").write_text(text)
    return tmp_path


def test_own_headers(spark, exported):
    t = io.read_tables(spark, str(exported), "csv")
    assert sorted(r[:2] for r in rows(Fn.funnel_weekly(t["events"]))) == [("2024-W01", 1), ("2024-W02", 1)]
    assert rows(t["events"].where("event_id = 2"), "ts") == [(dt.datetime(2024, 1, 1, 10, 1),)]
    dup = {r[0]: r[1:] for r in rows(P.duplicate_keys(t))}
    assert dup["order_items"] == ("item_id", 0) and all(d == 0 for _, d in dup.values())
    found = dict(rows(P.rule_violations(t)))
    assert found["primary_key_unique:order_items(item_id)"] == 0 and sum(found.values()) == 0
    assert not any("line_number" in r for r in found)


def test_violations_of_exported_lines(spark, exported):
    with open(exported / "order_items" / "more.csv", "w") as fh:
        fh.write("item_id,order_id,product_id,quantity,unit_price\n31,99,7,1,70.00\n,21,5,1,70.00\n,21,,1,70.00\n")
    found = dict(rows(P.rule_violations(io.read_tables(spark, str(exported), "csv"))))
    assert found["primary_key_unique:order_items(item_id)"] == 2  # 31 again, and a second NULL
    assert found["not_null:order_items.item_id"] == 2 and found["not_null:order_items.product_id"] == 1
    assert found["foreign_key:order_items.order_id->orders.order_id"] == 1
    assert found["foreign_key:order_items.product_id->products.product_id"] == 1


def test_value_that_does_not_parse(spark, exported):
    (exported / "orders" / "bad.csv").write_text(FILES["orders"].split("\n")[0] + "\n22,11,1,2024-01-02,12x,0.00,card,completed\n")
    path = str(exported / "orders")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(PySparkException, match="orders.total_amount: cannot read as decimal"):
                io.read_table(spark, path, "orders", "csv").collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
    kept = io.read_table(spark, path, "orders", "csv", bad_values="null")
    assert sorted(rows(kept, "order_id", "total_amount"))[1] == (22, None)
    assert dict(rows(io.bad_value_counts(spark, path, "orders")))["total_amount"] == 1


@pytest.mark.parametrize("column", ["order_id", "status"])
def test_missing_required_column(spark, exported, column):
    lines = [x.split(",") for x in FILES["orders"].strip().split("\n")]
    at = lines[0].index(column)
    (exported / "orders" / "part.csv").write_text("\n".join(",".join(x[:at] + x[at + 1:]) for x in lines))
    with pytest.raises(ValueError, match=f"orders: no column {column}"):
        io.read_table(spark, str(exported / "orders"), "orders", "csv")


def test_absent_optional_column_is_null(spark, exported):
    (exported / "sessions" / "part.csv").write_text("session_id,user_id,session_date,device_type,channel\n1,1,2024-01-01,mobile,email\n")
    assert rows(io.read_table(spark, str(exported / "sessions"), "sessions", "csv"), "landing_page") == [(None,)]


def test_files_added_between_two_calls_and_large_amounts(spark, tmp_path):
    make_driver_tables(str(tmp_path))
    orders = pq.read_table(tmp_path / "orders.parquet")
    (tmp_path / "orders.parquet").unlink()
    (tmp_path / "orders.parquet").mkdir()
    pq.write_table(orders, tmp_path / "orders.parquet" / "a.parquet")
    from shopmetrics.plans.registry import all_queries

    q = all_queries()["kpi_orders"]
    first = q(spark, str(tmp_path)).first()[0]
    more = orders.slice(0, 1).set_column(orders.schema.get_field_index("o_totalprice"), "o_totalprice", pa.array([2.5e10]))
    more = more.set_column(orders.schema.get_field_index("o_orderstatus"), "o_orderstatus", pa.array(["F"]))
    pq.write_table(more, tmp_path / "orders.parquet" / "b.parquet")
    assert q(spark, str(tmp_path)).first()[0] == first + 1
    top = DriverTables(spark, str(tmp_path)).orders
    assert D.kpi_revenue(top.where("total_amount > 1e10")).first()[0] == 2.5e10
