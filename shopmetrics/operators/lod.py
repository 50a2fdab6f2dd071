"""Level-of-detail expressions (A24, A25): FIXED aggregates beside a view of another level.

Order of operations: context filter, FIXED expressions, dimension filter, the view's aggregates.  A FIXED expression
therefore sees rows that the view's filter leaves out, but none that the context filter does, and its value is the same
on every row of its dimensions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Salts over which the rows of one value of the dimensions are spread when its aggregate is joined back.
SALTS = 16


@dataclass(frozen=True)
class Fixed:
    """``{FIXED dims : aggregate}`` as the column ``name``; no dims: over all rows."""

    name: str
    dims: Sequence[str]
    aggregate: Column


@dataclass(frozen=True)
class Computed:
    """A row-level column ``name``, from columns and FIXED expressions before it."""

    name: str
    value: Column


def with_fixed(rows: DataFrame, e: Fixed, salts: int = SALTS) -> DataFrame:
    """``rows`` with the expression's value.  The aggregate is reduced map-side and joined back on (dims, salt): a row's
    salt comes from its values, the aggregate's one row for each value is repeated for every salt, so a value that a third
    of the rows share is spread over ``salts`` tasks.  A NULL dimension is a value like any other."""
    keys = [f"_lod{i}" for i in range(len(e.dims))]
    per = rows.groupBy(*[F.col(d).alias(k) for d, k in zip(e.dims, keys)]).agg(e.aggregate.alias(e.name))
    per = per.withColumn("_lods", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = F.col("_salt") == F.col("_lods")
    for d, k in zip(e.dims, keys):
        on &= F.col(d).eqNullSafe(F.col(k))
    return rows.withColumn("_salt", F.pmod(F.hash(*rows.columns), F.lit(salts))).join(per, on).drop("_salt", "_lods", *keys)


def view(rows: DataFrame, steps: Sequence[Fixed | Computed], by: Sequence[str | Column], measures: Mapping[str, Column],
         where: Column | None = None, context: Column | None = None) -> DataFrame:
    """The view's dimensions ``by`` and ``measures`` of the rows within ``context`` and ``where``; ``steps`` in order."""
    rows = rows if context is None else rows.where(context)
    for s in steps:
        rows = with_fixed(rows, s) if isinstance(s, Fixed) else rows.withColumn(s.name, s.value)
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(*by).agg(*[m.alias(name) for name, m in measures.items()])
