"""Scalar expressions against independent Python formulations, over many values in one job."""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from shopmetrics.functions.exprs import month_diff, monday_week_key, period_key, round_n


def test_monday_week_key_matches_strftime(spark):
    rng = random.Random(5)
    days = [dt.date(1995, 1, 1) + dt.timedelta(days=rng.randrange(0, 12000)) for _ in range(3000)]
    days += [dt.date(y, 1, d) for y in range(2015, 2031) for d in range(1, 8)]
    days += [dt.date(y, 12, d) for y in range(2015, 2031) for d in range(25, 32)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(monday_week_key(F.col("d"))).collect()]
    assert got == [d.strftime("%Y-W%W") for d in days]


def test_month_diff_and_period_keys(spark):
    rng = random.Random(8)
    pairs = [(dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(0, 9000)),
              dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(0, 9000))) for _ in range(1000)]
    df = spark.createDataFrame(pairs, "a date, b date")
    out = df.select(month_diff("a", "b"), period_key("a", "month"), period_key("a", "month_of_year")).collect()
    for (a, b), (m, key, moy) in zip(pairs, out):
        assert m == (b.year - a.year) * 12 + b.month - a.month
        assert key == a.strftime("%Y-%m") and moy == a.month


def _half_up(x: float, n: int) -> float:
    d = Decimal(repr(x)).quantize(Decimal("1e-10"), ROUND_HALF_UP)
    return float(d.quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))


def test_round_n_is_half_away_from_zero(spark):
    rng = random.Random(3)
    vals = [round(rng.uniform(-1000, 1000), rng.choice([2, 3, 4, 6])) for _ in range(2000)]
    vals += [0.125, 0.135, 1.005, 2.675, -2.675, 1.0049999999, 0.285, 100.5, -0.5, 1e-12]
    vals += [a / b for a, b in zip(range(1, 300), range(7, 306))]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for n in (0, 1, 2):
        got = [r[0] for r in df.select(round_n("x", n)).collect()]
        assert got == [_half_up(v, n) for v in vals], n
