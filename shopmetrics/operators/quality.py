"""Data-quality operators: row counts, null counts, duplicate keys, constraint audits.

Each table is scanned once per operator: all per-column counts of a table come from a
single aggregate and are then unpivoted with ``stack``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmetrics.functions.exprs import round_n


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def tagged_union(frames: Mapping[str, DataFrame], cols: Mapping[str, Mapping[str, Column]] | None = None,
                 types: Mapping[str, str] | None = None) -> DataFrame:
    """Union of several tables as rows ``(_t = name, <cols>)``: each table is scanned once
    and any number of per-table counts and sums become ONE global aggregation of
    ``when(_t = name, ...)`` expressions (one final single-row stage instead of one per
    table).  ``cols[name]`` gives the table's expression for each output column
    (others are NULL of ``types[column]``)."""
    cols, types = cols or {}, types or {}
    parts = []
    for name, df in frames.items():
        own = cols.get(name, {})
        parts.append(df.select(F.lit(name).alias("_t"),
                               *[(own[c] if c in own else F.lit(None)).cast(t).alias(c) for c, t in types.items()]))
    return _union(parts)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, rows, columns (IO7 / E1): one column-less count per table."""
    return _union([
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        for name, df in tables.items()
    ])


def null_counts(name: str, df: DataFrame) -> DataFrame:
    """table, column, nulls, rows for every column of one table (one pass)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.count(F.when(F.col(f"`{c}`").isNull(), F.lit(1))).alias(f"_n{i}") for i, c in enumerate(cols)]
    args = ", ".join(f"'{c}', `_n{i}`" for i, c in enumerate(cols))
    wide = df.agg(*aggs)
    return wide.selectExpr(f"'{name}' as table", "_rows as rows",
                           f"stack({len(cols)}, {args}) as (`column`, nulls)")


def null_profile(tables: Mapping[str, DataFrame], only_with_nulls: bool = True) -> DataFrame:
    """Table, column, nulls, pct (1 dp of the table's rows)."""
    u = _union([null_counts(n, df) for n, df in tables.items()])
    if only_with_nulls:
        u = u.where(F.col("nulls") > 0)
    return u.select("table", "column", "nulls",
                    round_n(F.col("nulls").cast("double") / F.nullif(F.col("rows").cast("double"), F.lit(0.0))
                            * F.lit(100.0), 1).alias("pct"))


def duplicate_count(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: duplicates = rows - distinct key values (NULL counts as a value).

    groupBy(key) with map-side partial counts: a key repeated in a third of all rows
    is pre-summed per task before the shuffle."""
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicates"))


def duplicate_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Table, key, duplicates."""
    return _union([
        duplicate_count(tables[n], keys[n]).select(
            F.lit(n).alias("table"), F.lit(",".join(keys[n])).alias("key"), "duplicates")
        for n in tables if n in keys
    ])


@dataclass(frozen=True)
class Audit:
    """What one table adds to an audit: its key (with the rule that it is unique), references to other
    keys, and conditions (SQL) that count a violation where they hold."""

    frame: DataFrame
    key: Sequence[str]
    unique: str
    references: Sequence[tuple[str, str, str]]  # (column, unique rule of the key referred to, rule)
    conditions: Sequence[tuple[str, str]]


def audit(tables: Sequence[Audit]) -> DataFrame:
    """rule, violations for all tables in one pass over each.

    Every row turns into a few entries (kind, k1, k2): its own key, its non-NULL references and, if it breaks conditions, one
    entry with a bit for each of them.  One grouping by entry counts them with map-side partial counts, so a key that
    a third of all rows refer to is one row a task before the shuffle.  In it, a key's rows beyond the first are
    duplicates (NULL counts as a value, as pandas ``duplicated`` does), and references to a key without a
    row are orphans.  Keys are whole numbers, of two columns at most; a table has at most 63 conditions."""
    kinds = {t.unique: i for i, t in enumerate(tables)}  # of keys; the conditions of a table have a kind of their own
    slots: dict[str, tuple[int, int]] = {}  # of a reference: kind of the key, and its counter there
    for t in tables:
        for _, unique, rule in t.references:
            slots[rule] = (kinds[unique], sum(k == kinds[unique] for k, _ in slots.values()))
    width = max([0, *(slot + 1 for _, slot in slots.values())])

    def entry(kind: int, k1: str, k2: str, counter: int) -> str:
        """``counter`` -1: a row of the key itself; else the counter of a reference."""
        return f"named_struct('kind', {kind}, 'k1', cast({k1} as bigint), 'k2', cast({k2} as bigint), 'counter', {counter})"

    parts, found = [], {t.unique: f"kind = {kinds[t.unique]} then again" for t in tables}
    found |= {rule: f"kind = {kind} then s{slot}" for rule, (kind, slot) in slots.items()}
    for i, t in enumerate(tables):
        entries = [entry(kinds[t.unique], f"`{t.key[0]}`", f"`{t.key[1]}`" if len(t.key) > 1 else "null", -1)]
        for c, _, rule in t.references:
            kind, slot = slots[rule]
            entries.append(f"if(`{c}` is not null, {entry(kind, f'`{c}`', 'null', slot)}, null)")
        own = len(tables) + i
        if t.conditions:
            broken = " + ".join(f"if({holds}, {1 << k}L, 0L)" for k, (holds, _) in enumerate(t.conditions))
            entries.append(f"if(({broken}) > 0, {entry(own, broken, 'null', -1)}, null)")
            found |= {rule: f"kind = {own} and broken & {1 << k} != 0 then rows" for k, (_, rule) in enumerate(t.conditions)}
        parts.append(t.frame.selectExpr(f"inline(array({', '.join(entries)}))").where("kind is not null"))
    counts = ["count(if(counter = -1, 1, null)) as rows", *[f"count(if(counter = {i}, 1, null)) as s{i}" for i in range(width)]]
    counted = _union(parts).groupBy("kind", "k1", "k2").agg(*map(F.expr, counts))
    orphans = [f"sum(if(rows = 0, s{i}, 0)) as s{i}" for i in range(width)]
    per_kind = counted.groupBy("kind", F.expr(f"if(kind >= {len(tables)}, k1, 0)").alias("broken")).agg(
        *map(F.expr, ["sum(rows) as rows", "sum(greatest(rows - 1, 0)) as again", *orphans]))
    totals = per_kind.selectExpr(*[f"cast(coalesce(sum(case when {what} end), 0) as bigint) as _r{i}" for i, what in enumerate(found.values())])
    args = ", ".join(f"'{rule}', `_r{i}`" for i, rule in enumerate(found))
    return totals.selectExpr(f"stack({len(found)}, {args}) as (rule, violations)")
