"""Hot keys: AQE splits skewed shuffle joins between plain tables; per-key aggregate joins
are salted.  Thresholds are scaled down to the size of the generated data."""

from __future__ import annotations

import tempfile

import pyarrow.parquet as pq
import pytest
from test_random_differential import make_driver_tables

import __spark_entry__ as entry

SCALED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.files.maxPartitionBytes": "2k",
    "spark.sql.files.openCostInBytes": "1",
}


@pytest.fixture()
def scaled(spark):
    old = {k: spark.conf.get(k, None) for k in SCALED}
    for k, v in SCALED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


@pytest.fixture(scope="module")
def skewed_many_splits():
    root = tempfile.mkdtemp(prefix="shopmetrics-skew-")
    make_driver_tables(root)
    for t in ("orders", "lineitem", "events"):
        pq.write_table(pq.read_table(f"{root}/{t}.parquet"), f"{root}/{t}.parquet", row_group_size=64)
    return root


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_buyer_join_is_split_by_aqe(scaled, skewed_many_splits):
    plan = _final_plan(entry.queries()["orders_enriched"](scaled, skewed_many_splits))
    assert "SortMergeJoin(skew=true)" in plan


def test_hot_buyer_cohort_rows_are_spread(scaled, skewed_many_splits):
    """The orders of the buyer with a third of all meet its first month in many partitions, with the plain result."""
    from pyspark.sql import functions as F

    from shopmetrics.plans import cohort as C
    from shopmetrics.sources.adapters import DriverTables

    orders = DriverTables(scaled, skewed_many_splits).orders
    scaled.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        base = C.cohort_base(orders)
        assert base.where("user_id = 7").select(F.spark_partition_id()).distinct().count() > 4
        assert sorted(base.collect()) == sorted(C.cohort_base(orders, salts=1).collect())
    finally:
        scaled.conf.set("spark.sql.shuffle.partitions", "4")
