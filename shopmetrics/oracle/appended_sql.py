"""DuckDB oracle statements for the tables that arrive in batches: the same figures from the whole tables."""

from __future__ import annotations

from shopmetrics.model import STAGES
from shopmetrics.oracle.cohort_sql import GRID
from shopmetrics.oracle.prelude import with_prelude
from shopmetrics.oracle.sqlhelp import COMPLETED, div, pct, rnd


def sql(others: dict[str, str]) -> dict[str, str]:
    known = "WHERE event_type IN (" + ", ".join(f"'{x}'" for x in STAGES) + ")"
    spring = "coalesce(month(order_date) <= 6, false)"
    return {
        "cohort_report_appended": with_prelude(f"""
SELECT g.cohort_month, purchase_month, month_number, g.size0 AS cohort_size, buyers AS retained_users, {pct('buyers', 'g.size0', 2)} AS retention_pct,
       {rnd(div('buyers', 'g.size0') + ' * 100.0', 1)} AS retention_pct_1, g.n AS total_orders, {rnd('g.spent', 2)} AS cohort_revenue,
       {rnd(div('g.spent', 'priced'), 2)} AS avg_order_value, {rnd('running / CAST(g.size0 AS DOUBLE)', 2)} AS ltv, w.n AS cohort_orders,
       {rnd(div('w.n', 'w.size0'), 2)} AS avg_orders_per_user, {rnd('w.spent', 2)} AS total_revenue,
       {rnd(div('w.spent', 'w.size0'), 2)} AS avg_revenue_per_user
FROM (SELECT *, SUM({rnd('spent', 0)}) OVER (PARTITION BY cohort_month ORDER BY month_number ROWS UNBOUNDED PRECEDING) AS running FROM sized) g
JOIN whole w ON g.cohort_month = w.cohort_month""", GRID),
        "distinct_users_appended": with_prelude(f"""
SELECT 'overall' AS dimension, CAST(NULL AS VARCHAR) AS value, event_type AS stage, COUNT(DISTINCT user_id) AS users FROM c_events {known} GROUP BY 3
UNION ALL SELECT 'week', strftime(ts, '%Y-W%W'), event_type, COUNT(DISTINCT user_id) FROM c_events {known} GROUP BY 2, 3
UNION ALL SELECT 'device_type', s.device_type, event_type, COUNT(DISTINCT e.user_id) FROM c_events e JOIN c_sessions s USING (session_id) {known} GROUP BY 2, 3
UNION ALL SELECT 'channel', s.channel, event_type, COUNT(DISTINCT e.user_id) FROM c_events e JOIN c_sessions s USING (session_id) {known} GROUP BY 2, 3
UNION ALL SELECT 'customers', NULL, 'completed order', COUNT(DISTINCT user_id) FROM c_orders WHERE {COMPLETED} HAVING COUNT(*) > 0"""),
        # The first fault of a record in the order of its columns.
        "load_rejects": with_prelude("""
SELECT fault[1] AS "column", fault[2] AS reason, COUNT(*) AS records
FROM (SELECT CASE WHEN order_id IS NULL THEN ['order_id', 'no value'] WHEN session_id IS NULL THEN ['session_id', 'no value']
                  WHEN user_id IS NULL THEN ['user_id', 'no value']
                  WHEN order_date IS NULL OR status IS NULL OR status = 'returned' THEN ['order_date', 'no value']
                  WHEN status = 'cancelled' THEN ['total_amount', 'cannot read as decimal(18,2): n/a']
                  WHEN total_amount IS NULL THEN ['total_amount', 'no value'] WHEN payment_method IS NULL THEN ['payment_method', 'no value']
                  ELSE [NULL, 'accepted'] END AS fault FROM c_orders) GROUP BY 1, 2"""),
        "monthly_span": f"SELECT * FROM ({others['revenue_monthly_completed']}) WHERE month IN ('1996-03', '1996-04')",
        "orders_appended": with_prelude(f"""
SELECT status, COUNT(*) AS orders, CAST(SUM(total_amount) AS DOUBLE) AS revenue FROM c_orders WHERE order_id IS NOT NULL GROUP BY status
UNION ALL SELECT 'refused', COUNT(*) FILTER ({spring}), NULL FROM c_orders"""),
    }
