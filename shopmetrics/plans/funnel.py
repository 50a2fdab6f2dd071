"""Funnel metrics (F1–F7): distinct users per stage overall, by session dimension, by week
and by age group; stage-to-stage conversion; cart abandonment per product.

The funnel is not sequential: each stage counts its distinct users independently, and a
user counts once in every group (device, channel, week) they appear in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopmetrics.functions.exprs import pct, period_key, period_name, share_pct
from shopmetrics.model import COMPLETED, STAGES
from shopmetrics.operators.aggregates import ordered, top_k
from shopmetrics.operators.funnel_ops import stage_user_counts, user_stage_flags, wide_to_long


def _sum_flags(flags: DataFrame, dims: Sequence[str], stages: Sequence[str], suffix: str = "") -> DataFrame:
    return flags.groupBy(*dims).agg(
        *[F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(f"{s}{suffix}") for s in stages])


def _max_flags(flags: DataFrame, keys: Sequence[str], stages: Sequence[str]) -> DataFrame:
    return flags.groupBy(*keys).agg(*[F.max(s).alias(s) for s in stages])


def _overall_from(wide: DataFrame, stages: Sequence[str]) -> DataFrame:
    return wide_to_long(wide, [], list(stages), list(stages), "stage", "unique_users")


def _rates_from(wide: DataFrame, stages: Sequence[str]) -> DataFrame:
    args = ", ".join(f"{i}, '{s}', nullif(`{s}`, 0)" for i, s in enumerate(stages))
    j = wide.selectExpr(f"stack({len(stages)}, {args}) as (ordinal, stage, unique_users)")
    # Five rows: the ordered windows below run on one partition of a tiny frame.
    w = Window.orderBy("ordinal")
    top = F.first("unique_users").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    prev = F.lag("unique_users").over(w)
    return j.select(
        "ordinal",
        "stage",
        "unique_users",
        share_pct("unique_users", top, 2).alias("conversion_from_top_pct"),
        F.when(F.col("ordinal") == 0, F.lit(0.0)).otherwise(share_pct(prev - F.col("unique_users"), prev, 2))
        .alias("dropoff_from_prev_pct"),
        F.when(F.col("ordinal") == 0, F.lit(0).cast("long")).otherwise(prev - F.col("unique_users"))
        .alias("dropped_users"),
    ).transform(ordered("ordinal")).drop("ordinal")


def _share_of_max_from(wide: DataFrame, stages: Sequence[str]) -> DataFrame:
    f1 = _overall_from(wide, stages)
    mx = F.max("unique_users").over(Window.partitionBy())
    return f1.select("stage", "unique_users",
                     (F.col("unique_users").cast("double") / F.nullif(mx.cast("double"), F.lit(0.0)))
                     .alias("pct_of_max"))


def _transitions_from(wide: DataFrame, stages: Sequence[str]) -> DataFrame:
    pairs = list(zip(stages[:-1], stages[1:]))
    args = ", ".join(f"'{a} → {b}', `{a}`, `{b}`" for a, b in pairs)
    long = wide.selectExpr(f"stack({len(pairs)}, {args}) as (transition, from_users, to_users)")
    return long.select(
        "transition", "from_users", "to_users",
        pct("to_users", "from_users", 2).alias("conversion_rate_pct"),
        pct(F.col("from_users") - F.col("to_users"), "from_users", 2).alias("dropoff_rate_pct"),
    )


def _by_dimension_from(c: DataFrame, dim: str, stages: Sequence[str], style: str, order_by: str | None) -> DataFrame:
    first, last = stages[0], stages[-1]
    if style == "sql":
        cols = [F.col(s).alias(f"{s}_users") for s in stages]
        rate = pct(last, first, 2).alias("overall_conversion_pct")
        default_order = f"{first}_users"
    else:
        cols = [F.col(s) for s in stages]
        rate_name = "overall_conv_pct" if dim == "device_type" else "conv_pct"
        rate = share_pct(last, first, 2).alias(rate_name)
        default_order = last
    out = c.select(dim, *cols, rate)
    key = order_by or default_order
    return out.transform(ordered(F.col(key).desc_nulls_last(), F.col(dim)))


def _long_from(c: DataFrame, dim: str, stages: Sequence[str]) -> DataFrame:
    long = wide_to_long(c, [dim], list(stages), list(stages), "stage", "unique_users")
    return long.where(F.col("unique_users") > 0)


def _age_from(per_user: DataFrame, users: DataFrame, stages: Sequence[str]) -> DataFrame:
    u = users.select("user_id", "age_group")
    g = _sum_flags(per_user.join(u, "user_id"), ["age_group"], stages)
    first, last = stages[0], stages[-1]
    return g.select("age_group", *stages,
                    share_pct(last, first, 2).alias("conv_pct")) \
        .transform(ordered(F.col("age_group").asc_nulls_first()))


def _stage_counts_wide(events: DataFrame, stages: Sequence[str]) -> DataFrame:
    """One row: a bigint column per stage (0 when nobody reached it)."""
    return stage_user_counts(events, (), stages, suffix="")


def funnel_overall(events: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """stage, unique_users in stage order (0 for a stage without events)."""
    return _overall_from(_stage_counts_wide(events, stages), stages)


def funnel_rates(events: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """F1p: stage, unique_users, conversion_from_top_pct, dropoff_from_prev_pct,
    dropped_users.  A stage without events is kept with NULL users (reindex form)."""
    return _rates_from(_stage_counts_wide(events, stages), stages)


def funnel_share_of_max(events: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """F1t: stage, unique_users, pct_of_max = users / max(users over stages) (a fraction)."""
    return _share_of_max_from(_stage_counts_wide(events, stages), stages)


def funnel_transitions(events: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """transition, from_users, to_users, conversion_rate_pct, dropoff_rate_pct for
    each consecutive pair of stages (NULL rates when the from-stage has no users)."""
    return _transitions_from(_stage_counts_wide(events, stages), stages)


def _session_flags(events: DataFrame, sessions: DataFrame, dims: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """Per (dims, user) stage flags of events joined to their session (events ⋈ sessions).

    Events are first reduced to one flag row per (session, user): map-side partial
    aggregation shrinks a hot session to a handful of rows before any shuffle, so the
    join that follows is neither large nor skewed."""
    per_session = user_stage_flags(events, ["session_id"], stages)
    joined = per_session.join(sessions.select("session_id", *dims), "session_id")
    return _max_flags(joined, [*dims, "user_id"], stages)


def _session_dim_counts(events: DataFrame, sessions: DataFrame, dim: str, stages: Sequence[str]) -> DataFrame:
    """Distinct users per stage per session dimension value."""
    return _sum_flags(_session_flags(events, sessions, [dim], stages), [dim], stages)


def funnel_by_dimension(events: DataFrame, sessions: DataFrame, dim: str, stages: Sequence[str] = STAGES,
                        style: str = "sql", order_by: str | None = None) -> DataFrame:
    """F3/F4 (style="sql"): dim, <stage>_users..., overall_conversion_pct (2 dp).
    F3p/F4p (style="nb"): dim, <stage>..., <rate column> (2 dp)."""
    return _by_dimension_from(_session_dim_counts(events, sessions, dim, stages), dim, stages, style, order_by)


def by_dimension(wide: DataFrame, dim: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """F3/F4 from counted stages: dim and a column per stage."""
    return _by_dimension_from(wide, dim, stages, "sql", f"{stages[0]}_users" if dim == "device_type" else "overall_conversion_pct")


def funnel_by_device(events: DataFrame, sessions: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """by session device, ordered by page-view users."""
    return funnel_by_dimension(events, sessions, "device_type", stages, "sql", f"{stages[0]}_users")


def funnel_by_channel(events: DataFrame, sessions: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """by session channel, ordered by overall conversion."""
    return funnel_by_dimension(events, sessions, "channel", stages, "sql", "overall_conversion_pct")


def funnel_by_device_long(events: DataFrame, sessions: DataFrame, stages: Sequence[str] = STAGES) -> DataFrame:
    """F3t: device_type, stage, unique_users (long form; only pairs that occur)."""
    return _long_from(_session_dim_counts(events, sessions, "device_type", stages), "device_type", stages)


def funnel_weekly(events: DataFrame, stages: Sequence[str] = STAGES, style: str = "sql",
                  grain: str = "week") -> DataFrame:
    """week (Monday-first ``%Y-W%W``), <stage>_users...; F5p adds purchase_conv_pct.
    ``grain`` ("week", "month", "month_of_year") changes the time bucket."""
    key = period_name(grain)
    e = events.withColumn(key, period_key("ts", grain))
    suffix = "_users" if style == "sql" else ""
    c = stage_user_counts(e, [key], stages, suffix=suffix)
    if style != "sql":
        c = c.withColumn("purchase_conv_pct",
                         share_pct(stages[-1], stages[0], 2))
    return c.transform(ordered(key))


def funnel_by_age(events: DataFrame, users: DataFrame, stages: Sequence[str] = ("page_view", "purchase")) -> DataFrame:
    """age_group, page_view, purchase, conv_pct (events ⋈ users).

    Flags are aggregated per user before the join, so each user is one row on the
    join (a hot user cannot skew it) and the join reuses the user_id partitioning."""
    return _age_from(user_stage_flags(events, (), stages), users, stages)


def funnel_report(events: DataFrame, sessions: DataFrame, users: DataFrame,
                  stages: Sequence[str] = STAGES) -> dict[str, DataFrame]:
    """F1, F1p, F1t, F2, F3, F3p, F3t, F4, F4p and F7 from one pass over events.

    Events are reduced once to stage flags per (device, channel, user) — left-joined to
    sessions, so events without a known session still count in the overall funnel —
    and that frame is persisted (the caller unpersists it with the last output).  Every metric is
    then an aggregate of those flags (at most one row per user and session dimension
    pair), never a rescan of events."""
    per_session = user_stage_flags(events, ["session_id"], stages)
    s = sessions.select("session_id", "device_type", "channel", F.lit(1).alias("_in_session"))
    joined = per_session.join(s, "session_id", "left")
    base = _max_flags(joined, ["device_type", "channel", "_in_session", "user_id"], stages).persist()
    per_user = _max_flags(base, ["user_id"], stages)
    wide = _sum_flags(per_user, [], stages)
    in_session = base.where(F.col("_in_session") == 1)
    device = _sum_flags(_max_flags(in_session, ["device_type", "user_id"], stages), ["device_type"], stages)
    channel = _sum_flags(_max_flags(in_session, ["channel", "user_id"], stages), ["channel"], stages)
    age_stages = (stages[0], stages[-1])
    return {
        "funnel_overall": _overall_from(wide, stages),
        "funnel_rates": _rates_from(wide, stages),
        "funnel_share_of_max": _share_of_max_from(wide, stages),
        "funnel_transitions": _transitions_from(wide, stages),
        "funnel_by_device": _by_dimension_from(device, "device_type", stages, "sql", f"{stages[0]}_users"),
        "funnel_by_channel": _by_dimension_from(channel, "channel", stages, "sql", "overall_conversion_pct"),
        "funnel_by_device_nb": _by_dimension_from(device, "device_type", stages, "nb", None),
        "funnel_by_channel_nb": _by_dimension_from(channel, "channel", stages, "nb", None),
        "funnel_by_device_long": _long_from(device, "device_type", stages),
        "funnel_by_age": _age_from(per_user.select("user_id", *age_stages), users, age_stages),
    }


def cart_abandonment(events: DataFrame, order_items: DataFrame, orders: DataFrame, products: DataFrame,
                     k: int = 10, dp: int = 2, rate_col: str = "abandonment_rate_pct",
                     status: str = COMPLETED) -> DataFrame:
    """products most often added to cart by users who never bought them.

    A (user, product) cart pair is abandoned unless that user bought that product in any
    completed order.  The distinct cart pairs, the distinct bought pairs and the left
    join between them are one aggregation over the union of both pair sets, keyed by
    (product, user): one shuffle instead of two distincts and a join, and a hot product
    is still spread over its users.  A NULL user never bought anything: NULL matches no order."""
    cart = events.where((F.col("event_type") == "add_to_cart") & F.col("product_id").isNotNull()).select(
        "product_id", "user_id", F.lit(1).alias("in_cart"), F.lit(0).alias("bought"))
    done = orders.where((F.col("status") == status) & F.col("user_id").isNotNull()).select("order_id", "user_id")
    bought = order_items.select("order_id", "product_id").join(done, "order_id").select(
        "product_id", "user_id", F.lit(0).alias("in_cart"), F.lit(1).alias("bought"))
    pairs = cart.unionByName(bought).groupBy("product_id", "user_id").agg(
        F.max("in_cart").alias("in_cart"), F.max("bought").alias("bought"))
    per_product = pairs.where(F.col("in_cart") == 1).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("cart_adds"),
        F.count(F.when(F.col("bought") == 1, F.lit(1))).alias("purchases"),
    ).withColumn("abandoned", F.col("cart_adds") - F.col("purchases"))
    p = products.select("product_id", "product_name", "subcategory", F.col("price").cast("double").alias("price"))
    out = per_product.join(p, "product_id").select(
        "product_id", "product_name", "subcategory", "price", "cart_adds", "purchases", "abandoned",
        pct("abandoned", "cart_adds", dp).alias(rate_col),
    )
    return top_k(out, k, [F.col(rate_col).desc_nulls_last(), F.col("product_id").asc()])
