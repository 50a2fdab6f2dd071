"""Reading and writing the canonical tables (IO1–IO6).

Sources always apply the declared schema (never inference), so a CSV export and a
parquet table read back to the same types.  Sinks write one directory per table; on a
cluster the path is a shared filesystem or object store, never a machine-local folder.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.model import HEADER_NAMES, SCHEMAS, required, schema_of

# Timestamps in CSV exports: full microseconds, space separator (read back by cast,
# which also accepts the ISO 'T' form and fewer fraction digits).
_CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def conform(df: DataFrame, table: str, bad_values: str = "fail") -> DataFrame:
    """Select and cast ``df`` to the declared schema of ``table``.

    Columns are matched by name (``HEADER_NAMES`` lists other names in exports); extra columns are
    left out.  A column of the key or a NOT NULL one must be there; any other absent column
    is NULL.  A value that does not parse fails the read, or with ``bad_values="null"`` becomes
    NULL (``bad_value_counts`` tells how many there are)."""
    df = df.withColumnsRenamed({a: b for a, b in HEADER_NAMES.get(table, {}).items() if b not in df.columns})
    missing = [c for c in required(table, df.columns) if c not in df.columns]
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)} in the source (it has {', '.join(df.columns)})")
    if bad_values not in ("fail", "null"):
        raise ValueError(f"bad_values must be 'fail' or 'null', got {bad_values!r}")
    cols = []
    for f in schema_of(table, df.columns).fields:
        if f.name not in df.columns:
            value = F.lit(None).cast(f.dataType)
        elif bad_values == "null":
            value = F.col(f"`{f.name}`").try_cast(f.dataType)
        else:
            # Fails also where the session's ANSI mode is off and a plain cast would give NULL.
            c = F.col(f"`{f.name}`")
            bad = F.concat(F.lit(f"{table}.{f.name}: cannot read as {f.dataType.simpleString()}: "), c.cast("string"))
            value = c if df.schema[f.name].dataType == f.dataType else F.when(
                c.isNotNull() & c.try_cast(f.dataType).isNull(), F.raise_error(bad).cast(f.dataType)).otherwise(c.try_cast(f.dataType))
        cols.append(value.alias(f.name))
    return df.select(*cols)


def _source(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "csv":
        # Read as text and cast once to the declared types: no inference pass over the data.
        return (spark.read.option("header", True).option("encoding", "UTF-8").option("sep", ",")
                .option("inferSchema", False).csv(path))
    raise ValueError(f"unsupported format {fmt!r}")


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet", bad_values: str = "fail") -> DataFrame:
    """IO1/IO3: one canonical table from ``path`` in ``fmt`` (parquet or csv); see ``conform``."""
    return conform(_source(spark, path, fmt), table, bad_values)


def bad_value_counts(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    """column, bad_values: how many values of each column ``bad_values="null"`` would turn to NULL (one pass)."""
    raw = _source(spark, path, fmt)
    raw = raw.withColumnsRenamed({a: b for a, b in HEADER_NAMES.get(table, {}).items() if b not in raw.columns})
    fields = [f for f in schema_of(table, raw.columns).fields if f.name in raw.columns]
    wide = raw.agg(*[F.count(F.when(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(), 1)).alias(f.name)
                     for f in fields])
    args = ", ".join(f"'{f.name}', `{f.name}`" for f in fields)
    return wide.selectExpr(f"stack({len(fields)}, {args}) as (`column`, bad_values)")


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet", bad_values: str = "fail") -> dict[str, DataFrame]:
    """All six canonical tables from ``root/<table>`` directories."""
    return {t: read_table(spark, f"{root.rstrip('/')}/{t}", t, fmt, bad_values) for t in SCHEMAS}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """IO4–IO6: write one table.  CSV gets a header and ISO timestamps; ``mode="append"``
    adds rows to an existing table."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", _CSV_TIMESTAMP_FORMAT).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def write_tables(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write every table under ``root/<name>``."""
    for name, df in tables.items():
        write_table(df, f"{root.rstrip('/')}/{name}", fmt, mode)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, mode: str = "overwrite") -> DataFrame:
    """Store a canonical table bucketed (and sorted) by ``key`` at ``path`` and register
    it as ``table`` in the session catalog; returns ``spark.table(table)``.

    Tables bucketed alike on the join / grouping key co-locate: a per-user aggregation or
    window (cohorts, repeat purchases, per-user funnel flags) and an orders ⋈ users join
    then read each bucket in place with no shuffle.  ``path`` is a shared folder on a
    cluster."""
    (df.write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)
