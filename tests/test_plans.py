"""Plan-shape checks over every registered metric on the smallest driver tables."""

from __future__ import annotations

import os

import pytest
from conftest import SF_SMALL, make_orders, make_users, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shopmetrics.oracle import all_sql
from shopmetrics.plans.registry import all_queries
from shopmetrics.sources.adapters import DriverTables
from shopmetrics.plans import dashboard as D
from shopmetrics.plans import revenue as R

pytestmark = pytest.mark.skipif(not os.path.exists(SF_SMALL), reason="driver tables not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "total_orders", "total_revenue", "avg_order_value", "total_discounts"]
    assert df.count() > 0


def test_every_metric_has_an_oracle():
    assert set(all_queries()) == set(all_sql())
    assert set(all_queries()) <= set(entry.queries()) and set(all_sql()) <= set(entry.oracle_sql())


def test_no_cartesian_products_and_no_expand_in_funnels(spark):
    bad = {}
    for name, q in all_queries().items():
        plan = _plan(q(spark, SF_SMALL))
        for op in ("CartesianProduct", "BroadcastNestedLoopJoin"):
            if op in plan:
                bad[name] = op
        if name.startswith("funnel") and "Expand" in plan:
            bad[name] = "Expand"
    assert bad == {}


def test_scans_read_only_needed_columns(spark):
    plan = _plan(entry.queries()["kpi_orders"](spark, SF_SMALL))
    # orders only: no line items (the discount join is removed) and two columns read
    assert "lineitem" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan


def test_discount_filter_is_pushed_into_the_lineitem_scan(spark):
    plan = _plan(entry.queries()["revenue_monthly"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)" in plan


def test_filter_action_keeps_orders_of_one_acquisition_channel(spark):
    users = make_users(spark)
    users = users.withColumn("acquisition_channel", F.when(users.user_id == 1, "email").otherwise("direct"))
    o = D.filter_by_acquisition_channel(make_orders(spark), users, "email")
    assert sorted(r[0] for r in rows(o, "order_id")) == [1, 2]
    assert rows(R.revenue_monthly(o)) == [("2024-01", 1, 100.0, 100.0, 0.0), ("2024-03", 1, 50.0, 50.0, 5.0)]


def test_t10_month_part_merges_years(spark):
    rows_ = [(1, 1, "2023-01-05", 10, 0, "completed"), (2, 2, "2024-01-07", 10, 0, "completed"),
             (3, 3, "2024-01-09", 10, 0, "cancelled"), (4, 2, "2024-02-01", 10, 0, "completed")]
    out = rows(D.retention_lod(make_orders(spark, rows_), month_part=True))
    # January cohorts of 2023 (size 1) and 2024 (size 2) share row 1: 2 retained / min size 1
    assert out == [(1, 0, 2, 1, 2.0), (1, 1, 1, 2, 0.5)]


@pytest.fixture()
def no_broadcast(spark):
    """The plans of large tables: no side is small enough to be broadcast."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in names}
    for k in names:
        spark.conf.set(k, "-1")
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _shape(spark, name):
    plan = _plan(all_queries()[name](spark, SF_SMALL))
    return {"scans": plan.count("FileScan parquet"), "hash": plan.count("Exchange hashpartitioning"),
            "single": plan.count("Exchange SinglePartition"), "list": plan.count("LocalTableScan"), "plan": plan}


def test_audit_reads_each_table_once(no_broadcast):
    s = _shape(no_broadcast, "rule_violations")
    # users, sessions and orders are derived by joins and groupings of their own.
    own = sum(_shape_of(df)["hash"] for df in DriverTables(no_broadcast, SF_SMALL).as_dict().values())
    assert s["scans"] <= 11 and s["hash"] <= own + 2 and s["single"] == 1


def _shape_of(df):
    plan = _plan(df)
    return {"hash": plan.count("Exchange hashpartitioning")}


@pytest.mark.parametrize("name", ["revenue_by_subcategory", "revenue_by_subcategory_margin", "top_products_by_name"])
def test_lines_are_shuffled_twice_only(no_broadcast, name):
    assert _shape(no_broadcast, name)["hash"] <= 5


def test_rates_make_no_frame_of_a_list(no_broadcast):
    assert _shape(no_broadcast, "funnel_rates")["list"] == 0


@pytest.mark.parametrize("name", ["revenue_by_acq_channel", "revenue_by_country", "revenue_by_device_all"])
def test_orders_are_reduced_before_the_join(no_broadcast, name):
    plan = _shape(no_broadcast, name)["plan"]
    key = "session_id" if name.endswith("all") else "user_id"
    # What crosses the first exchange of orders is a partial sum per key.
    at = plan.index("partial_sum(total_amount")
    assert f"keys=[{key}" in plan[plan.rindex("HashAggregate(", 0, at): at]


def test_cohort_base_has_one_path(no_broadcast):
    s = _shape(no_broadcast, "cohort_base")
    assert s["scans"] <= 2 and "Broadcast" not in s["plan"]


def test_matrices_write_no_files(spark, tmp_path):
    from pyspark.sql import DataFrame

    before = DataFrame.checkpoint
    try:
        DataFrame.checkpoint = None  # calling it would fail
        for name in ("retention_matrix_wide", "revenue_matrix_wide", "ltv_matrix_wide"):
            assert all_queries()[name](spark, SF_SMALL).count() > 0
    finally:
        DataFrame.checkpoint = before
        spark.catalog.clearCache()
