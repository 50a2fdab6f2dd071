"""Cohorts kept up by appended orders (J7, C1–C8 and A15 without reading old orders).

Two stored tables, both of signed changes that add up: per (buyer, month) the completed orders, and per (cohort, month)
the cells of every cohort metric.  A batch holds order versions with a sign: +1 for a version that holds from
now on, -1 for one that no longer does (an order that turns from completed to returned is taken back).  Counts
and sums can be taken back; a buyer's first month can't, so the cells of the buyers a batch touches are computed
anew: their contribution after the batch minus the one before.  Only the buckets of these buyers are read.

A batch counts once its cells are written, which is its last write: a run that dies before leaves the old
state, the same batch again is complete or does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.functions.exprs import month_diff, month_start
from shopmetrics.model import COMPLETED, MONEY
from shopmetrics.plans.cohort import cells_of_months, with_size
from shopmetrics.sources.batches import BatchStore

_SUM = T.DecimalType(38, 2)
MONTHS = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("order_start", T.DateType()), T.StructField("n_orders", T.LongType()),
                       T.StructField("n_amounts", T.LongType()), T.StructField("revenue", _SUM)])
CELLS = T.StructType([T.StructField("cohort_start", T.DateType()), T.StructField("order_start", T.DateType()), T.StructField("users", T.LongType()),
                      T.StructField("orders", T.LongType()), T.StructField("amounts", T.LongType()), T.StructField("revenue", _SUM)])


def signed(orders: DataFrame, sign: int = 1) -> DataFrame:
    """Order versions that begin (+1) or cease (-1) to hold."""
    return orders.withColumn("sign", F.lit(sign))


def corrections(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that turn the order versions ``old`` into ``new``."""
    return signed(old, -1).unionByName(signed(new, 1))


class CohortState:
    """State of the cohort metrics in a folder.  ``buckets``: hash buckets of buyers, fixed for the life of the state."""

    def __init__(self, spark: SparkSession, path: str, status: str = COMPLETED, buckets: int = 64):
        self.status, self.buckets = status, buckets
        self.months = BatchStore(spark, f"{path.rstrip('/')}/months", MONTHS, [T.StructField("bucket", T.IntegerType())])
        self.changes = BatchStore(spark, f"{path.rstrip('/')}/cells", CELLS)

    def before(self, touched: list[int]) -> DataFrame:
        """The stored changes of the buyers in these buckets."""
        batches = self.changes.committed()
        if not batches:
            return self.months.spark.createDataFrame([], MONTHS)
        return self.months.read_batches(batches).where(F.col("bucket").isin(touched)).select(*MONTHS.names)

    def apply(self, changes: DataFrame, batch: str) -> bool:
        """Take in a batch of signed order versions (user_id, order_date, total_amount, status, sign); False if it was already."""
        if batch in self.changes.committed():
            return False
        c = changes.where((F.col("status") == self.status) & F.col("user_id").isNotNull())
        amount = F.col("total_amount").cast(MONEY)
        new = c.groupBy("user_id", month_start("order_date").alias("order_start")).agg(
            F.sum("sign").cast("long").alias("n_orders"), F.sum(F.when(amount.isNotNull(), F.col("sign")).otherwise(0)).cast("long").alias("n_amounts"),
            F.coalesce(F.sum(amount * F.col("sign")), F.lit(0)).cast(_SUM).alias("revenue"))
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")
        self.months.write(new.withColumn("bucket", bucket).where("n_orders != 0 or n_amounts != 0 or revenue != 0"), batch)
        own = self.months.read_batches([batch])
        touched = [r[0] for r in own.select("bucket").distinct().collect()]
        own = own.select(*MONTHS.names)
        buyers = own.select("user_id").distinct()
        before = self.before(touched).join(buyers, "user_id", "left_semi")
        after = _cells(before.unionByName(own))
        gone = _cells(before)
        for c in ("users", "orders", "amounts", "revenue"):
            gone = gone.withColumn(c, -F.col(c))
        delta = _added(after.unionByName(gone)).where("users != 0 or orders != 0 or amounts != 0 or revenue != 0")
        # A batch without changes gets an empty row, so that it counts too.
        marker = self.months.spark.createDataFrame([(None, None, 0, 0, 0, None)], CELLS)
        self.changes.write(delta.select(*[F.col(f.name).cast(f.dataType) for f in CELLS]).unionByName(marker).coalesce(1), batch)
        return True

    def cells(self) -> DataFrame:
        """The cells of ``cohort.cohort_cells`` for all orders so far, from the stored changes alone."""
        c = _added(self.changes.read().where(F.col("cohort_start").isNotNull())).where("users > 0")
        return with_size(c.withColumn("month_number", month_diff("cohort_start", "order_start")).withColumn("revenue", F.when(F.col("amounts") > 0, F.col("revenue"))))


def _added(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cohort_start", "order_start").agg(*[F.sum(c).alias(c) for c in ("users", "orders", "amounts", "revenue")])


def _cells(changes: DataFrame) -> DataFrame:
    """Cells of the buyers whose (buyer, month) changes these are."""
    now = changes.groupBy("user_id", "order_start").agg(F.sum("n_orders").alias("n_orders"), F.sum("n_amounts").alias("n_amounts"),
                                                        F.sum("revenue").alias("revenue")).where("n_orders > 0")
    return cells_of_months(now).select("cohort_start", "order_start", "users", "orders", "amounts", "revenue")
