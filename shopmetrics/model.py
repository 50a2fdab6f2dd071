"""Canonical data model: six commerce tables, their Spark schemas and domain values.

Every metric in :mod:`shopmetrics.plans` is a ``DataFrame -> DataFrame`` function over
these tables.  Schemas are explicit ``StructType`` values (never inferred); money is
``decimal(18,2)`` so sums are exact and independent of partition order, and the final
projection of each metric casts to ``double``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the modelled project's domain values).
# Funnel stages in order; order statuses; dimension value lists.
STAGES = ["page_view", "product_view", "add_to_cart", "checkout_start", "purchase"]
STATUSES = ["completed", "returned", "cancelled"]
DEVICES = ["desktop", "mobile", "tablet"]
CHANNELS = ["organic_search", "paid_search", "social_media", "email", "direct", "referral"]
COMPLETED = "completed"
DEFAULT_CATEGORY = "Electronics"
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(18, 2)
UNIT_PRICE = T.DecimalType(18, 4)

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("signup_date", T.DateType(), True),
        T.StructField("country", T.StringType(), True),
        T.StructField("device_type", T.StringType(), True),
        T.StructField("acquisition_channel", T.StringType(), True),
        T.StructField("age_group", T.StringType(), True),
        T.StructField("email", T.StringType(), True),
    ]
)

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType(), False),
        T.StructField("product_name", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("subcategory", T.StringType(), True),
        T.StructField("brand", T.StringType(), True),
        T.StructField("price", MONEY, True),
        T.StructField("cost", MONEY, True),
        T.StructField("stock_quantity", T.IntegerType(), True),
    ]
)

SESSIONS = T.StructType(
    [
        T.StructField("session_id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("session_date", T.DateType(), True),
        T.StructField("session_hour", T.IntegerType(), True),
        T.StructField("device_type", T.StringType(), True),
        T.StructField("channel", T.StringType(), True),
        T.StructField("landing_page", T.StringType(), True),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("session_id", T.LongType(), True),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("event_type", T.StringType(), True),
        T.StructField("product_id", T.LongType(), True),
        T.StructField("ts", T.TimestampNTZType(), True),
        T.StructField("page", T.StringType(), True),
    ]
)

ORDERS = T.StructType(
    [
        T.StructField("order_id", T.LongType(), False),
        T.StructField("session_id", T.LongType(), True),
        T.StructField("user_id", T.LongType(), True),
        T.StructField("order_date", T.DateType(), True),
        T.StructField("total_amount", MONEY, True),
        T.StructField("discount_amount", MONEY, True),
        T.StructField("payment_method", T.StringType(), True),
        T.StructField("status", T.StringType(), True),
    ]
)

# The driver's line items carry no surrogate key; (order_id, line_number) is their
# natural key.  An exported table has ``item_id`` instead (ORDER_ITEMS_BY_ID).
ORDER_ITEMS = T.StructType(
    [
        T.StructField("order_id", T.LongType(), False),
        T.StructField("line_number", T.IntegerType(), True),
        T.StructField("product_id", T.LongType(), True),
        T.StructField("quantity", T.IntegerType(), True),
        T.StructField("unit_price", UNIT_PRICE, True),
    ]
)

ORDER_ITEMS_BY_ID = T.StructType([T.StructField("item_id", T.LongType(), False),
                                  *[f for f in ORDER_ITEMS.fields if f.name != "line_number"]])

SCHEMAS: dict[str, T.StructType] = {
    "users": USERS,
    "products": PRODUCTS,
    "sessions": SESSIONS,
    "events": EVENTS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
}

# ---------------------------------------------------------------------------
# Fixed values (must equal the modelled project's declared rules).
# Primary key of each table.
PRIMARY_KEYS: dict[str, list[str]] = {
    "users": ["user_id"],
    "products": ["product_id"],
    "sessions": ["session_id"],
    "events": ["event_id"],
    "orders": ["order_id"],
    "order_items": ["order_id", "line_number"],
}

# Declared NOT NULL columns.
NOT_NULL: dict[str, list[str]] = {
    "users": ["signup_date", "country", "device_type", "acquisition_channel"],
    "products": ["product_name", "category", "subcategory", "price", "cost"],
    "sessions": ["user_id", "session_date", "device_type", "channel"],
    "events": ["session_id", "user_id", "event_type", "ts"],
    "orders": ["session_id", "user_id", "order_date", "total_amount", "discount_amount",
               "payment_method", "status"],
    "order_items": ["order_id", "product_id", "quantity", "unit_price"],
}

# Declared foreign keys (child table, child column, parent table, parent column).
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("sessions", "user_id", "users", "user_id"),
    ("events", "session_id", "sessions", "session_id"),
    ("events", "user_id", "users", "user_id"),
    ("events", "product_id", "products", "product_id"),
    ("orders", "session_id", "sessions", "session_id"),
    ("orders", "user_id", "users", "user_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
]

# CHECK constraints (E16): column must be one of the values.
CHECKS: list[tuple[str, str, list[str]]] = [
    ("events", "event_type", STAGES),
    ("orders", "status", STATUSES),
]
# Other header names of a column in exported files.
HEADER_NAMES: dict[str, dict[str, str]] = {"events": {"timestamp": "ts"}}
# ---------------------------------------------------------------------------


def schema_of(table: str, columns: Iterable[str]) -> T.StructType:
    """The declared schema of ``table`` for a source with these columns."""
    return ORDER_ITEMS_BY_ID if table == "order_items" and "item_id" in columns else SCHEMAS[table]


def key_of(table: str, columns: Iterable[str]) -> list[str]:
    """The primary key of ``table`` for a frame with these columns."""
    return ["item_id"] if table == "order_items" and "item_id" in columns else PRIMARY_KEYS[table]


def required(table: str, columns: Iterable[str]) -> list[str]:
    """Columns a source of ``table`` must have: its key and the NOT NULL ones."""
    return list(dict.fromkeys([*key_of(table, columns), *NOT_NULL[table]]))
