"""Helpers shared by the operators: column names, shared-folder tables, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Salts of the joins whose key may hold a third of all rows.
SALTS = 16


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or ``base`` with underscores until no column of ``df`` has that name
    (upper and lower case count as equal, as in Spark SQL)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def free_prefix(df: DataFrame, base: str, fields: Sequence[T.StructField]) -> str:
    """``base``, or ``base`` with underscores until no column of ``df`` is called prefix + field."""
    taken = {c.lower() for c in df.columns}
    while any((base + f.name).lower() in taken for f in fields):
        base += "_"
    return base


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables: ``spark.checkpoint.dir`` of the session.
    Only a local session that names none (a test) gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="llm-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: lineage is cut,
    a lost executor costs nothing, and later reads don't compute it again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salt_of(*cols: Column | str, salts: int = SALTS) -> Column:
    """A salt from 0 to ``salts - 1`` that depends on the row's values only."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def with_all_salts(df: DataFrame, name: str, salts: int = SALTS) -> DataFrame:
    """Every row of a (small) frame once per salt."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(i) for i in range(salts)])))


def salted_join(rows: DataFrame, per_key: DataFrame, key: Sequence[str], spread: Sequence[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``per_key`` (one row for each key) on ``key``.  Rows of one key
    are dealt over ``salts`` partitions by the columns ``spread``; ``per_key`` is repeated for
    each salt, so a key that holds a third of all rows loads no single task."""
    s = free_name(rows, "salt")
    left = rows.withColumn(s, salt_of(*spread, salts=salts))
    return left.join(with_all_salts(per_key, s, salts), [*key, s], how).drop(s)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the offsets of the texts
    (one more than rows).  Null is read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset: column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0]: at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (one row may be longer)."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


def append_columns(df: DataFrame, fields: Sequence[T.StructField],
                   fn: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """``df`` with more columns, computed batch by batch in Arrow with no shuffle.  ``fn`` is
    called once a task and returns the function of a batch.  A new column whose name ``df`` has already gets underscores."""
    taken, new = {c.lower() for c in df.columns}, []
    for f in fields:
        name = f.name
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        new.append(T.StructField(name, f.dataType, f.nullable))
    schema = T.StructType([*df.schema.fields, *new])
    names = [f.name for f in schema.fields]

    def run(batches):
        of = fn()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *of(b)], names=names)

    return df.mapInArrow(run, schema)
