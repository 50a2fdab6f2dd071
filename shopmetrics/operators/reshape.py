"""Long -> wide reshaping (RS1/RS3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmetrics.operators.aggregates import ordered


def pivot_wide(long: DataFrame, row_key: str, col_key: str, value: str, prefix: str = "",
               keys: Sequence[int] | None = None) -> DataFrame:
    """One row per ``row_key``, one column ``<prefix><col_key value>`` per key.

    ``keys`` names the columns; without it the observed values are collected, whose number
    is bounded by the domain (e.g. months of history), never by the data volume.  ``long`` (an
    aggregate, e.g. cohort x month cells) is then persisted, so that the keys and the
    pivot come from one computation.  Cells absent from ``long`` are NULL.
    """
    if keys is None:
        long = long.persist()
        keys = sorted(r[0] for r in long.select(col_key).distinct().collect() if r[0] is not None)
    labels = [f"{prefix}{k}" for k in keys]
    labelled = long.select(row_key, F.concat(F.lit(prefix), F.col(col_key).cast("string")).alias("_label"), value)
    return labelled.groupBy(row_key).pivot("_label", labels).agg(F.first(value)).transform(ordered(row_key))
