"""Stage-funnel operators.

``COUNT(DISTINCT CASE WHEN stage = s THEN user END)`` for five stages side by side makes
Catalyst ``Expand`` the input five times (one copy per distinct aggregate).  The same
numbers come from two plain aggregations: per (dims, user) a 0/1 flag per stage (partial
aggregation map-side, one shuffle keyed by user), then per dims a sum of flags over a
frame with at most one row per user.  No Expand, no distinct aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.model import STAGES


def user_stage_flags(events: DataFrame, dims: Sequence[str] = (), stages: Sequence[str] = STAGES,
                     user: str = "user_id", stage_col: str = "event_type") -> DataFrame:
    """One row per (dims, user) with an int flag column per stage (1 = reached).

    Every event row keeps its group (as ``COUNT(DISTINCT CASE ...)`` does): rows of
    other event types or without a user give all-zero flags."""
    known = F.col(user).isNotNull()
    flags = [F.max(F.when(known & (F.col(stage_col) == s), F.lit(1)).otherwise(F.lit(0))).alias(s)
             for s in stages]
    return events.groupBy(*dims, user).agg(*flags)


def stage_user_counts(events: DataFrame, dims: Sequence[str] = (), stages: Sequence[str] = STAGES,
                      suffix: str = "_users", user: str = "user_id",
                      stage_col: str = "event_type") -> DataFrame:
    """Distinct users per stage per dims group, wide: ``dims..., <stage><suffix>...``.

    Counts are bigint and 0 (not NULL) for a stage nobody reached in a group.
    """
    flags = user_stage_flags(events, dims, stages, user, stage_col)
    sums = [F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(f"{s}{suffix}") for s in stages]
    return flags.groupBy(*dims).agg(*sums)


def wide_to_long(df: DataFrame, keep: Sequence[str], columns: Sequence[str], names: Sequence[str],
                 name_col: str, value_col: str) -> DataFrame:
    """``stack``: each input row becomes one row per column (SO1/RS4), a narrow operator."""
    args = ", ".join(f"'{n}', `{c}`" for n, c in zip(names, columns))
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(columns)}, {args}) as (`{name_col}`, `{value_col}`)")
