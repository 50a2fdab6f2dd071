"""DuckDB oracle statements for the profile / quality metrics."""

from __future__ import annotations

from shopmetrics.model import CHECKS, FOREIGN_KEYS, NOT_NULL, PRIMARY_KEYS, SCHEMAS
from shopmetrics.oracle.prelude import with_prelude
from shopmetrics.oracle.sqlhelp import COMPLETED, avg, pct, rnd

CTE = {"users": "c_users", "products": "c_products", "sessions": "c_sessions", "events": "c_events",
       "orders": "c_orders", "order_items": "c_items"}


def _hist(source: str, value: str, bins: int) -> str:
    """Equal-width histogram with numpy's edge rules over ``value`` of ``source``."""
    return f"""
vals AS (SELECT CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL),
rng AS (SELECT CASE WHEN MIN(v) = MAX(v) THEN MIN(v) - 0.5 ELSE MIN(v) END AS lo,
               CASE WHEN MIN(v) = MAX(v) THEN MAX(v) + 0.5 ELSE MAX(v) END AS hi FROM vals),
b0 AS (SELECT v, lo, hi, (hi - lo) / CAST({bins} AS DOUBLE) AS w,
              CAST(LEAST(floor((v - lo) * (CAST({bins} AS DOUBLE) / (hi - lo))), {bins - 1}) AS INTEGER) AS b0
       FROM vals, rng),
b1 AS (SELECT v, lo, w, CASE WHEN v < lo + b0 * w THEN b0 - 1 ELSE b0 END AS b1 FROM b0),
b2 AS (SELECT CASE WHEN v >= lo + (b1 + 1) * w AND b1 <> {bins - 1} THEN b1 + 1 ELSE b1 END AS bin FROM b1),
cnt AS (SELECT bin, COUNT(*) AS n FROM b2 GROUP BY bin),
edges AS (SELECT CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / CAST({bins} AS DOUBLE)) AS lo,
                 CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / CAST({bins} AS DOUBLE)) END AS hi
          FROM range({bins}) t(i), rng),
hist AS (SELECT e.bin, e.lo, e.hi, CAST(COALESCE(c.n, 0) AS BIGINT) AS count
         FROM edges e LEFT JOIN cnt c ON e.bin = c.bin)"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["table_profile"] = with_prelude("\nUNION ALL\n".join(
        f"SELECT '{t}' AS \"table\", COUNT(*) AS rows, {len(s.fields)} AS columns FROM {CTE[t]}"
        for t, s in SCHEMAS.items()))
    nulls = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS \"table\", '{f.name}' AS \"column\", COUNT(*) FILTER (WHERE {f.name} IS NULL) AS nulls, "
        f"COUNT(*) AS n FROM {CTE[t]}"
        for t, s in SCHEMAS.items() for f in s.fields)
    q["null_profile"] = with_prelude(
        f"SELECT \"table\", \"column\", nulls, {rnd('CAST(nulls AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0.0) * 100.0', 1)} AS pct "
        f"FROM ({nulls}) WHERE nulls > 0")
    q["duplicate_keys"] = with_prelude("\nUNION ALL\n".join(
        f"SELECT '{t}' AS \"table\", '{','.join(k)}' AS key, "
        f"CAST((SELECT COUNT(*) FROM {CTE[t]}) - (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(k)} FROM {CTE[t]})) AS BIGINT) AS duplicates"
        for t, k in PRIMARY_KEYS.items()))
    q["date_ranges"] = with_prelude(
        "SELECT 'sessions' AS \"table\", 'session_date' AS \"column\", CAST(MIN(session_date) AS VARCHAR) AS min_date, "
        "CAST(MAX(session_date) AS VARCHAR) AS max_date FROM c_sessions\nUNION ALL\n"
        "SELECT 'orders', 'order_date', CAST(MIN(order_date) AS VARCHAR), CAST(MAX(order_date) AS VARCHAR) FROM c_orders")
    q["status_split"] = with_prelude(
        f"SELECT status, {rnd('CAST(COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) * 100.0', 1)} AS pct "
        "FROM c_orders WHERE status IS NOT NULL GROUP BY status")
    dims = ["acquisition_channel", "country", "device_type", "age_group"]
    demo = "\nUNION ALL\n".join(
        f"SELECT '{d}' AS dimension, {d} AS value, COUNT(*) AS users FROM c_users WHERE {d} IS NOT NULL GROUP BY {d}"
        for d in dims)
    q["user_demographics"] = with_prelude(
        "SELECT dimension, value, users FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dimension "
        f"ORDER BY users DESC, value) AS rk FROM ({demo})) WHERE dimension <> 'country' OR rk <= 10")
    q["sessions_daily"] = with_prelude(
        "SELECT CAST(session_date AS VARCHAR) AS session_date, COUNT(*) AS sessions FROM c_sessions "
        "WHERE session_date IS NOT NULL GROUP BY 1")
    q["sessions_hourly"] = with_prelude(
        "SELECT session_hour, COUNT(*) AS sessions FROM c_sessions WHERE session_hour IS NOT NULL GROUP BY 1")
    q["price_histogram"] = with_prelude("SELECT * FROM hist", _hist("c_products", "price", 30))
    q["avg_price_by_subcategory"] = with_prelude(
        f"SELECT subcategory, {rnd(avg('price'), 2)} AS avg_price FROM c_products "
        "WHERE subcategory IS NOT NULL GROUP BY subcategory")
    q["order_value_histogram"] = with_prelude(
        f"SELECT h.*, (SELECT {rnd(avg('total_amount'), 2)} FROM c_orders WHERE {COMPLETED}) AS mean_order_value "
        "FROM hist h",
        "done AS (SELECT * FROM c_orders WHERE status = 'completed')," + _hist("done", "total_amount", 40))
    q["payment_method_counts"] = with_prelude(
        "SELECT payment_method, COUNT(*) AS orders FROM c_orders WHERE payment_method IS NOT NULL GROUP BY 1")
    q["event_type_counts"] = with_prelude(
        "SELECT event_type, COUNT(*) AS events FROM c_events WHERE event_type IS NOT NULL GROUP BY 1")
    q["products_per_subcategory"] = with_prelude(
        "SELECT subcategory, COUNT(*) AS products FROM c_products WHERE subcategory IS NOT NULL GROUP BY 1")
    q["project_summary"] = with_prelude(f"""
SELECT 'users' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM c_users
UNION ALL SELECT 'sessions', CAST(COUNT(*) AS DOUBLE) FROM c_sessions
UNION ALL SELECT 'events', CAST(COUNT(*) AS DOUBLE) FROM c_events
UNION ALL SELECT 'completed_orders', CAST(COUNT(*) AS DOUBLE) FROM c_orders WHERE {COMPLETED}
UNION ALL SELECT 'total_revenue', {rnd('SUM(total_amount)', 2)} FROM c_orders WHERE {COMPLETED}
UNION ALL SELECT 'avg_order_value', {rnd(avg('total_amount'), 2)} FROM c_orders WHERE {COMPLETED}
UNION ALL SELECT 'total_discounts', {rnd('SUM(discount_amount)', 2)} FROM c_orders WHERE {COMPLETED}
UNION ALL SELECT 'session_to_purchase_pct',
          {pct('(SELECT COUNT(*) FROM c_orders)', '(SELECT COUNT(*) FROM c_sessions)', 1)}
UNION ALL SELECT 'repeat_buyer_pct', {pct('COUNT(*) FILTER (WHERE n >= 2)', 'COUNT(*)', 1)}
          FROM (SELECT user_id, COUNT(*) AS n FROM c_orders WHERE {COMPLETED} GROUP BY user_id)""")
    q["footer_row_counts"] = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", COUNT(*) AS rows FROM {t}" for t in (
        "region", "nation", "customer", "part", "orders", "lineitem", "events"))
    rules: list[str] = []
    for t, k in PRIMARY_KEYS.items():
        rules.append(
            f"SELECT 'primary_key_unique:{t}({','.join(k)})' AS rule, "
            f"CAST((SELECT COUNT(*) FROM {CTE[t]}) - (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(k)} "
            f"FROM {CTE[t]})) AS BIGINT) AS violations")
    for t, cols in NOT_NULL.items():
        checks = list(dict.fromkeys([c for c in PRIMARY_KEYS[t] if c not in cols] + cols))
        for c in checks:
            rules.append(f"SELECT 'not_null:{t}.{c}', CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) FROM {CTE[t]}")
    for t, c, allowed in CHECKS:
        vals = ", ".join(f"'{v}'" for v in allowed)
        rules.append(f"SELECT 'check:{t}.{c}', CAST(COUNT(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({vals})) "
                     f"AS BIGINT) FROM {CTE[t]}")
    for child, c, parent, pc in FOREIGN_KEYS:
        rules.append(f"SELECT 'foreign_key:{child}.{c}->{parent}.{pc}', CAST(COUNT(*) AS BIGINT) FROM {CTE[child]} x "
                     f"WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {CTE[parent]} p WHERE p.{pc} = x.{c})")
    q["rule_violations"] = with_prelude("\nUNION ALL\n".join(rules))
    return q
