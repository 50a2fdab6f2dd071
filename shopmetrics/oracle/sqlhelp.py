"""SQL text helpers that spell the engine's numeric conventions in DuckDB.

They mirror :mod:`shopmetrics.functions.exprs`: half-up rounding through
``decimal(38,10)``, AVG as exact sum / count in double, percentages in double.
"""

from __future__ import annotations


def rnd(x: str, n: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def avg(x: str) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / CAST(NULLIF(COUNT({x}), 0) AS DOUBLE))"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0.0))"


def pct(a: str, b: str, n: int = 2) -> str:
    return rnd(f"CAST(100.0 AS DOUBLE) * CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0.0)", n)


def month(d: str) -> str:
    return f"strftime({d}, '%Y-%m')"


def month_diff(a: str, b: str) -> str:
    """Calendar months from date ``a`` to date ``b`` as INTEGER."""
    return f"CAST((year({b}) * 12 + month({b})) - (year({a}) * 12 + month({a})) AS INTEGER)"


COMPLETED = "status = 'completed'"
