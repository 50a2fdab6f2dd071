"""Driver tables (TPC-H-like parquet) -> the six canonical commerce tables.

The mapping is deterministic and purely declarative (projections, one aggregation per
derived table, left joins), so Catalyst prunes columns and pushes filters into the
parquet scans of whatever a metric actually reads.  The DuckDB oracle prelude in
:mod:`shopmetrics.oracle.prelude` states the same mapping in SQL.

Mapping (see FIXTURES.md §3):

* users    = customer ⟕ nation ⟕ region; country = nation name, age_group = region
             name, acquisition_channel = market segment, device from ``custkey mod 3``.
* products = part; subcategory = type, cost = 0.55 · price.
* events   = events relabelled onto the five funnel stages; the session is
             ``-(year(ts)·18·10^12 + user_id·1000 + day_of_year(ts))``; ``product_id = props.k`` on
             product_view / add_to_cart.
* sessions = one per event session (first event) ∪ one per order; channel and device
             are read off the session id.
* orders   = orders; F/O/P -> completed/returned/cancelled, payment = priority,
             discount = Σ extendedprice·discount of the order's returned ('R') lines.
* order_items = lineitem; unit_price = extendedprice / quantity.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.model import CHANNELS, DEFAULT_CATEGORY, DEVICES, MONEY, UNIT_PRICE

# ---------------------------------------------------------------------------
# Fixed values of the adapter (our own test mapping, not the modelled project's).
EVENT_RELABEL = {
    "view": "page_view",
    "click": "product_view",
    "signup": "add_to_cart",
    "error": "checkout_start",
    "purchase": "purchase",
}
ORDER_STATUS_RELABEL = {"F": "completed", "O": "returned", "P": "cancelled"}
PRODUCT_EVENTS = ["product_view", "add_to_cart"]
COST_RATIO = "0.55"
# Distance of two years' session ids: beyond any user's part, and a multiple of 18, so that channel and
# device (read off the id) don't depend on the year.
YEAR_STEP = 18_000_000_000_000
# ---------------------------------------------------------------------------


def decimal_of(c: Column, dtype) -> Column:
    """double -> decimal, rounded half-up on 8 decimals first so binary noise of the
    double (x.xx4999999 for x.xx5) cannot flip the rounding.  Holds any value the target
    type does."""
    return F.round(c.cast("decimal(38,8)"), dtype.scale).cast(dtype)


def _relabel(c: Column, mapping: dict[str, str]) -> Column:
    """Nested IFs, which Catalyst folds under a comparison with a label: ``status = 'completed'`` becomes
    ``o_orderstatus <=> 'F'`` and is pushed into the scan (a CASE of several branches isn't)."""
    out = F.lit(None).cast("string")
    for src, dst in reversed(mapping.items()):
        out = F.call_function("if", c.eqNullSafe(src), F.lit(dst), out)
    return out


def _pick(values: list[str], index: Column) -> Column:
    """``values[index]`` for a 0-based integer index; NULL for a NULL index."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def session_channel(session_id: Column) -> Column:
    return _pick(CHANNELS, F.abs(session_id) % len(CHANNELS))


def session_device(session_id: Column) -> Column:
    return _pick(DEVICES, F.call_function("div", F.abs(session_id), F.lit(len(CHANNELS))) % len(DEVICES))


def users_from(customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    n = nation.select("n_nationkey", "n_name", "n_regionkey")
    r = region.select("r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    j = c.join(geo, c.c_nationkey == geo.n_nationkey, "left")
    return j.select(
        F.col("c_custkey").alias("user_id"),
        F.lit(None).cast("date").alias("signup_date"),
        F.col("n_name").alias("country"),
        _pick(DEVICES, F.col("c_custkey") % len(DEVICES)).alias("device_type"),
        F.col("c_mktsegment").alias("acquisition_channel"),
        F.col("r_name").alias("age_group"),
        F.lit(None).cast("string").alias("email"),
    )


def products_from(part: DataFrame) -> DataFrame:
    price = decimal_of(F.col("p_retailprice"), MONEY)
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.lit(DEFAULT_CATEGORY).alias("category"),
        F.col("p_type").alias("subcategory"),
        F.col("p_brand").alias("brand"),
        price.alias("price"),
        F.round(price * F.lit(COST_RATIO).cast("decimal(3,2)"), 2).cast(MONEY).alias("cost"),
        F.lit(None).cast("int").alias("stock_quantity"),
    )


def events_from(events: DataFrame) -> DataFrame:
    stage = _relabel(F.col("event_type"), EVENT_RELABEL)
    e = events.select("event_id", "ts", "user_id", "event_type", "props").withColumn("stage", stage)
    return e.select(
        F.col("event_id"),
        (-(F.year("ts") * F.lit(YEAR_STEP) + F.col("user_id") * 1000 + F.dayofyear("ts"))).alias("session_id"),
        F.col("user_id"),
        F.col("stage").alias("event_type"),
        F.when(F.col("stage").isin(*PRODUCT_EVENTS), F.get_json_object("props", "$.k").cast("long"))
        .alias("product_id"),
        F.col("ts"),
        F.lit(None).cast("string").alias("page"),
    )


def sessions_from(canonical_events: DataFrame, orders: DataFrame) -> DataFrame:
    # One row per event session: partial aggregation map-side, one shuffle by session.
    ev = canonical_events.groupBy("session_id", "user_id").agg(F.min("ts").alias("first_ts"))
    ev = ev.select("session_id", "user_id", F.to_date("first_ts").alias("session_date"),
                   F.hour("first_ts").alias("session_hour"))
    od = orders.select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("user_id"),
        F.to_date("o_orderdate").alias("session_date"),
        F.hour("o_orderdate").alias("session_hour"),
    )
    s = ev.unionByName(od)
    return s.select(
        "session_id",
        "user_id",
        "session_date",
        F.col("session_hour").cast("int").alias("session_hour"),
        session_device(F.col("session_id")).alias("device_type"),
        session_channel(F.col("session_id")).alias("channel"),
        F.lit(None).cast("string").alias("landing_page"),
    )


def order_discounts_from(lineitem: DataFrame) -> DataFrame:
    """Σ extendedprice·discount per order over returned lines; unique on l_orderkey."""
    r = lineitem.where(F.col("l_returnflag") == "R").select(
        "l_orderkey", decimal_of(F.col("l_extendedprice") * F.col("l_discount"), MONEY).alias("d")
    )
    return r.groupBy("l_orderkey").agg(F.sum("d").alias("discount"))


def orders_from(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                      "o_orderpriority")
    d = order_discounts_from(lineitem)
    # Left join on a key that is unique on the right: Catalyst drops the whole branch
    # when a metric never reads discount_amount.
    j = o.join(d, o.o_orderkey == d.l_orderkey, "left")
    return j.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("user_id"),
        F.to_date("o_orderdate").alias("order_date"),
        decimal_of(F.col("o_totalprice"), MONEY).alias("total_amount"),
        F.coalesce(F.col("discount").cast(MONEY), F.lit(0).cast(MONEY)).alias("discount_amount"),
        F.col("o_orderpriority").alias("payment_method"),
        _relabel(F.col("o_orderstatus"), ORDER_STATUS_RELABEL).alias("status"),
    )


def order_items_from(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("int").alias("line_number"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        decimal_of(F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0)), UNIT_PRICE)
        .alias("unit_price"),
    )


class DriverTables:
    """Lazily derived canonical tables over one directory of driver parquet files.

    Each property is a logical plan only; nothing is read until an action runs, and
    only the columns a metric touches are scanned.  An object keeps the file listing of its
    first use; ``driver_tables`` gives one that fits the files there now.
    """

    RAW = ("region", "nation", "customer", "part", "orders", "lineitem", "events")

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        return users_from(self.raw("customer"), self.raw("nation"), self.raw("region"))

    @cached_property
    def products(self) -> DataFrame:
        return products_from(self.raw("part"))

    @cached_property
    def events(self) -> DataFrame:
        return events_from(self.raw("events"))

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions_from(self.events, self.raw("orders"))

    @cached_property
    def orders(self) -> DataFrame:
        return orders_from(self.raw("orders"), self.raw("lineitem"))

    @cached_property
    def order_items(self) -> DataFrame:
        return order_items_from(self.raw("lineitem"))

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in ("users", "products", "sessions", "events", "orders", "order_items")}


_TABLES: WeakKeyDictionary[SparkSession, dict[str, tuple[tuple[str, ...], DriverTables]]] = WeakKeyDictionary()


def listing(spark: SparkSession, paths: Sequence[str]) -> tuple[str, ...]:
    """Names, sizes and modification times of the files at each path (a file or a folder; "" if there is none), by the
    file system Spark reads with."""
    jvm = spark.sparkContext._jvm
    at = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    fs = at[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    show = jvm.org.apache.commons.lang3.ArrayUtils.toString
    return tuple(re.sub("access_time=[0-9]+", "", show(fs.listStatus(p))) if fs.exists(p) else "" for p in at)


def driver_tables(spark: SparkSession, sf_dir: str) -> DriverTables:
    """The canonical tables over ``sf_dir``.  Their definitions (schemas read from footers, analysed plans) are built
    once for a session and folder, and again as soon as a file is added, replaced or removed; no data is kept."""
    folder = sf_dir.rstrip("/")
    now = listing(spark, [f"{folder}/{name}.parquet" for name in DriverTables.RAW])
    known = _TABLES.setdefault(spark, {})
    if folder not in known or known[folder][0] != now:
        known[folder] = (now, DriverTables(spark, folder))
    return known[folder][1]
