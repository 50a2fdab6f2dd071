"""Independent DuckDB formulations of every metric, for differential checking."""

from __future__ import annotations

from collections.abc import Sequence

from shopmetrics.oracle import appended_sql, cohort_sql, dashboard_sql, funnel_sql, profile_sql, revenue_sql


def all_sql(months: Sequence[int] = cohort_sql.MONTHS) -> dict[str, str]:
    """``months``: the month numbers for which the cohort matrices have a column."""
    out: dict[str, str] = {}
    out.update(cohort_sql.sql(months))
    out.update(dashboard_sql.sql())
    out.update(profile_sql.sql())
    out.update(funnel_sql.sql())
    out.update(revenue_sql.sql())
    out.update(appended_sql.sql(out))
    return out
