"""The canonical-table mapping of :mod:`shopmetrics.sources.adapters`, written as DuckDB CTEs.

Every oracle statement is ``WITH <prelude>, <its own CTEs> SELECT ...`` over the raw
driver views (customer, nation, region, part, events, orders, lineitem).  The canonical
tables are named ``c_users, c_products, c_events, c_sessions, c_orders, c_items``.
"""

from __future__ import annotations

_M2 = "CAST(ROUND(CAST({x} AS DECIMAL(38,8)), 2) AS DECIMAL(18,2))"
_M4 = "CAST(ROUND(CAST({x} AS DECIMAL(38,8)), 4) AS DECIMAL(18,4))"

PRELUDE_CTES = f"""
c_users AS (
    SELECT c.c_custkey AS user_id,
           CAST(NULL AS DATE) AS signup_date,
           n.n_name AS country,
           (['desktop','mobile','tablet'])[(c.c_custkey % 3) + 1] AS device_type,
           c.c_mktsegment AS acquisition_channel,
           r.r_name AS age_group,
           CAST(NULL AS VARCHAR) AS email
    FROM customer c
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
),
c_products AS (
    SELECT p_partkey AS product_id,
           p_name AS product_name,
           'Electronics' AS category,
           p_type AS subcategory,
           p_brand AS brand,
           {_M2.format(x="p_retailprice")} AS price,
           CAST(ROUND({_M2.format(x="p_retailprice")} * CAST(0.55 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS cost,
           CAST(NULL AS INTEGER) AS stock_quantity
    FROM part
),
c_events AS (
    SELECT event_id,
           -(year(ts) * 18000000000000 + user_id * 1000 + dayofyear(ts)) AS session_id,
           user_id,
           CASE event_type WHEN 'view' THEN 'page_view'
                           WHEN 'click' THEN 'product_view'
                           WHEN 'signup' THEN 'add_to_cart'
                           WHEN 'error' THEN 'checkout_start'
                           WHEN 'purchase' THEN 'purchase' END AS event_type,
           CASE WHEN event_type IN ('click', 'signup')
                THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS product_id,
           ts,
           CAST(NULL AS VARCHAR) AS page
    FROM events
),
c_sessions_base AS (
    SELECT session_id, user_id, CAST(MIN(ts) AS DATE) AS session_date,
           CAST(hour(MIN(ts)) AS INTEGER) AS session_hour
    FROM c_events GROUP BY session_id, user_id
    UNION ALL
    SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE), CAST(hour(o_orderdate) AS INTEGER)
    FROM orders
),
c_sessions AS (
    SELECT session_id, user_id, session_date, session_hour,
           (['desktop','mobile','tablet'])[((abs(session_id) // 6) % 3) + 1] AS device_type,
           (['organic_search','paid_search','social_media','email','direct','referral'])[(abs(session_id) % 6) + 1] AS channel,
           CAST(NULL AS VARCHAR) AS landing_page
    FROM c_sessions_base
),
c_discounts AS (
    SELECT l_orderkey, SUM({_M2.format(x="l_extendedprice * l_discount")}) AS discount
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
),
c_orders AS (
    SELECT o.o_orderkey AS order_id,
           o.o_orderkey AS session_id,
           o.o_custkey AS user_id,
           CAST(o.o_orderdate AS DATE) AS order_date,
           {_M2.format(x="o.o_totalprice")} AS total_amount,
           CAST(COALESCE(d.discount, 0) AS DECIMAL(18,2)) AS discount_amount,
           o.o_orderpriority AS payment_method,
           CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'returned'
                                WHEN 'P' THEN 'cancelled' END AS status
    FROM orders o LEFT JOIN c_discounts d ON o.o_orderkey = d.l_orderkey
),
c_items AS (
    SELECT l_orderkey AS order_id,
           CAST(l_linenumber AS INTEGER) AS line_number,
           l_partkey AS product_id,
           CAST(trunc(l_quantity) AS INTEGER) AS quantity,
           {_M4.format(x="l_extendedprice / NULLIF(l_quantity, 0)")} AS unit_price
    FROM lineitem
)"""


def with_prelude(body: str, ctes: str = "") -> str:
    """``WITH <prelude>[, ctes] <body>``."""
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    return f"WITH {PRELUDE_CTES.strip()}{extra}\n{body.strip()}"
