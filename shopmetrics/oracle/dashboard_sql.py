"""DuckDB oracle statements for the dashboard measures."""

from __future__ import annotations

from shopmetrics.oracle.prelude import with_prelude
from shopmetrics.oracle.sqlhelp import COMPLETED, avg, div, month, month_diff, pct, rnd

_X1 = """
x1 AS (SELECT o.order_id, o.session_id, o.user_id, o.order_date, o.total_amount, o.discount_amount,
              o.payment_method, o.status, s.device_type, s.channel, u.country, u.age_group, u.acquisition_channel
       FROM c_orders o
       LEFT JOIN c_sessions s ON o.session_id = s.session_id
       LEFT JOIN c_users u ON o.user_id = u.user_id)"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["orders_enriched"] = with_prelude(
        "SELECT order_id, session_id, user_id, CAST(order_date AS VARCHAR) AS order_date, "
        "CAST(total_amount AS DOUBLE) AS total_amount, CAST(discount_amount AS DOUBLE) AS discount_amount, "
        "payment_method, status, device_type, channel, country, age_group, acquisition_channel FROM x1", _X1)
    q["kpi_orders"] = with_prelude(f"SELECT COUNT(order_id) AS orders FROM c_orders WHERE {COMPLETED}")
    q["kpi_revenue"] = with_prelude(f"SELECT {rnd('SUM(total_amount)', 2)} AS revenue FROM c_orders WHERE {COMPLETED}")
    q["kpi_customers"] = with_prelude(f"SELECT COUNT(DISTINCT user_id) AS customers FROM c_orders WHERE {COMPLETED}")
    q["kpi_aov"] = with_prelude(f"SELECT {rnd(avg('total_amount'), 2)} AS aov FROM c_orders WHERE {COMPLETED}")
    q["trend_month_part"] = with_prelude(
        f"SELECT CAST(month(order_date) AS INTEGER) AS month, {rnd('SUM(total_amount)', 2)} AS revenue, "
        f"{rnd(avg('total_amount'), 2)} AS aov FROM c_orders WHERE {COMPLETED} GROUP BY 1")
    q["revenue_by_payment"] = with_prelude(
        f"SELECT payment_method, {rnd('SUM(total_amount)', 2)} AS revenue FROM c_orders GROUP BY 1")
    q["revenue_by_acq_channel"] = with_prelude(
        f"SELECT acquisition_channel, {rnd('rev', 2)} AS revenue, {rnd('aov', 2)} AS aov, "
        f"{rnd('AVG(CAST(rev AS DOUBLE)) OVER ()', 2)} AS avg_line "
        f"FROM (SELECT acquisition_channel, SUM(total_amount) AS rev, {avg('total_amount')} AS aov "
        f"FROM x1 WHERE {COMPLETED} GROUP BY 1)", _X1)
    q["revenue_by_country"] = with_prelude(
        f"SELECT country, {rnd('SUM(total_amount)', 2)} AS revenue FROM x1 GROUP BY 1", _X1)
    q["revenue_by_device_all"] = with_prelude(
        f"SELECT device_type, {rnd('SUM(total_amount)', 2)} AS revenue FROM x1 GROUP BY 1", _X1)
    q["retention_lod"] = with_prelude(f"""
SELECT {month('c.cohort')} AS cohort_month, c.month_number, c.retained_users, s.cohort_size,
       {div('c.retained_users', 's.cohort_size')} AS retention
FROM (SELECT cohort, {month_diff('cohort', 'om')} AS month_number,
             COUNT(DISTINCT CASE WHEN o.{COMPLETED} THEN o.user_id END) AS retained_users
      FROM (SELECT *, date_trunc('month', order_date) AS om FROM c_orders) o JOIN fp ON o.user_id = fp.user_id
      GROUP BY 1, 2) c
JOIN (SELECT cohort, COUNT(DISTINCT user_id) AS cohort_size FROM fp GROUP BY cohort) s ON c.cohort = s.cohort
WHERE c.retained_users > 0""", "fp AS (SELECT user_id, date_trunc('month', MIN(order_date)) AS cohort "
                               "FROM c_orders GROUP BY user_id)")
    q["retention_lod_month_part"] = with_prelude(f"""
SELECT CAST(month(c.cohort) AS INTEGER) AS cohort_month, c.month_number,
       CAST(SUM(c.retained_users) AS BIGINT) AS retained_users, MIN(s.cohort_size) AS cohort_size,
       {div('SUM(c.retained_users)', 'MIN(s.cohort_size)')} AS retention
FROM (SELECT cohort, {month_diff('cohort', 'om')} AS month_number,
             COUNT(DISTINCT CASE WHEN o.{COMPLETED} THEN o.user_id END) AS retained_users
      FROM (SELECT *, date_trunc('month', order_date) AS om FROM c_orders) o JOIN fp ON o.user_id = fp.user_id
      GROUP BY 1, 2) c
JOIN (SELECT cohort, COUNT(DISTINCT user_id) AS cohort_size FROM fp GROUP BY cohort) s ON c.cohort = s.cohort
WHERE c.retained_users > 0
GROUP BY 1, 2""", "fp AS (SELECT user_id, date_trunc('month', MIN(order_date)) AS cohort "
                  "FROM c_orders GROUP BY user_id)")
    q["kpi_conversion"] = with_prelude(
        "SELECT purchases, page_views, " + div("purchases", "page_views") + " AS conversion_rate FROM "
        "(SELECT COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases, "
        "COUNT(*) FILTER (WHERE event_type = 'page_view') AS page_views FROM c_events)")
    q["kpi_repeat_rate"] = with_prelude(
        "SELECT buyers, repeat_buyers, " + div("repeat_buyers", "buyers") + " AS repeat_buyer_rate FROM "
        "(SELECT COUNT(*) AS buyers, COUNT(*) FILTER (WHERE n >= 2) AS repeat_buyers FROM "
        f"(SELECT user_id, COUNT(*) AS n FROM c_orders WHERE {COMPLETED} GROUP BY user_id))")
    q["retention_fixed"] = q["retention_lod"]
    q["channel_payment_share"] = with_prelude(f"""
SELECT acquisition_channel, payment_method, {rnd('done', 2)} AS revenue, {rnd('whole', 2)} AS channel_revenue, {pct('done', 'whole', 2)} AS share_pct
FROM (SELECT acquisition_channel, payment_method, SUM(total_amount) FILTER ({COMPLETED}) AS done, COUNT(*) FILTER ({COMPLETED}) AS n,
             SUM(SUM(total_amount)) OVER (PARTITION BY acquisition_channel) AS whole
      FROM c_orders LEFT JOIN c_users USING (user_id) GROUP BY acquisition_channel, payment_method) WHERE n > 0""")
    return q
