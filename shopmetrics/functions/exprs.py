"""Scalar column expressions shared by every metric.

All of them are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopmetrics.model import MONEY


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Cast to the exact money type; done once at the table boundary."""
    return col(c).cast(MONEY)


def round_n(c: str | Column, n: int) -> Column:
    """Round half away from zero to ``n`` places and return a double.

    Going through ``decimal(38,10)`` first removes binary noise of the double, so
    ``x.xx5`` computed as ``x.xx4999999`` still rounds up, the same in every engine.
    """
    return F.round(col(c).cast("decimal(38,10)"), n).cast("double")


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as double, NULL when ``den`` is 0 or NULL (never an error)."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def pct(num: str | Column, den: str | Column, n: int = 2) -> Column:
    """``ROUND(100 * num / NULLIF(den, 0), n)`` in double arithmetic."""
    return round_n(F.lit(100.0) * col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0)), n)


def share_pct(num: str | Column, den: str | Column, n: int = 2) -> Column:
    """``round(num / den * 100, n)`` — the notebooks' order of operations (divide first),
    which can differ from :func:`pct` in the last bit before rounding; NULL on 0."""
    return round_n(ratio(num, den) * F.lit(100.0), n)


def exact_avg(c: str | Column) -> Column:
    """AVG of a decimal or integer column: exact sum / non-null count, as double."""
    return F.sum(col(c)).cast("double") / F.nullif(F.count(col(c)), F.lit(0)).cast("double")


def month_key(d: str | Column) -> Column:
    """``strftime('%Y-%m', d)``."""
    return F.date_format(col(d), "yyyy-MM")


def month_start(d: str | Column) -> Column:
    """First day of the month of ``d`` (a date)."""
    return F.trunc(F.to_date(col(d)), "MM")


def month_index(d: str | Column) -> Column:
    """Months since year 0: ``year*12 + month``; differences give month numbers."""
    return F.year(col(d)) * 12 + F.month(col(d))


def month_diff(start: str | Column, end: str | Column) -> Column:
    """``(Y2-Y1)*12 + (M2-M1)`` as int: calendar months between two dates."""
    return (month_index(end) - month_index(start)).cast("int")


def monday_week_key(ts: str | Column) -> Column:
    """``strftime('%Y-W%W', ts)``: Monday-first week, week 00 before the first Monday.

    ``%W = (day_of_year_0based + 7 - weekday_monday0) div 7``; a week that crosses New
    Year is split between the two calendar years.  Not ISO ``weekofyear``.
    """
    d = F.to_date(col(ts))
    week = F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7).cast("int")
    return F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


GRAINS = ("month", "week", "month_of_year")


def period_key(d: str | Column, grain: str) -> Column:
    """Time bucket of a date/timestamp: ``month`` ('yyyy-MM'), ``week`` (Monday-first
    'yyyy-Www', as :func:`monday_week_key`) or ``month_of_year`` (1–12, years merged)."""
    if grain == "month":
        return month_key(d)
    if grain == "week":
        return monday_week_key(d)
    if grain == "month_of_year":
        return F.month(col(d))
    raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")


def period_name(grain: str) -> str:
    """Output column name for a grain."""
    return "week" if grain == "week" else "month"
