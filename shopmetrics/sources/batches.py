"""Tables that grow by batches (IO6): keyed, and safe to retry.

A table is a folder with one sub-folder for each batch, ``batch=<id>``, which is a partition of it.  A batch is written by
one Spark job that overwrites its own folder only: rows of other batches are never touched, readers see a batch
once its write has finished (Spark's ``_SUCCESS``), so a write that dies half-way leaves the old rows, and the
same batch again writes the same rows to the same place.  One writer at a time; paths are on a file system that driver and executors share.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.model import key_of, schema_of
from shopmetrics.sources.io import conform

BATCH = "batch"


def work_folder(spark: SparkSession) -> str:
    """A new folder for a table of this run, below the session's ``spark.checkpoint.dir``; only a local session that names
    none (a test) gets a temporary one.  Whoever clears the checkpoint folder removes it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="shopmetrics-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


class BatchStore:
    """The folder of a table: writes one batch, reads all or some of them."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, parts: list[T.StructField] = ()):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), list(parts)
        self.columns = schema.names
        # Rows come back as written: a nullable copy of the declared schema, then the partition columns.
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields] + self.parts + [T.StructField(BATCH, T.StringType())])

    def folder(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
            raise ValueError(f"a batch is named by letters, digits, - and _, got {batch!r}")
        return f"{self.path}/{BATCH}={batch}"

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def committed(self) -> list[str]:
        """The batches that are there whole: Spark marks a finished write.  One name each."""
        fs, at = self._fs(f"{self.path}/{BATCH}=*/_SUCCESS")
        found = self.spark.sparkContext._jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.globStatus(at))
        return sorted(set(re.findall(rf"/{BATCH}=([A-Za-z0-9_-]+)/_SUCCESS", found)))

    def write(self, rows: DataFrame, batch: str) -> None:
        """Overwrite the folder of ``batch`` with ``rows``, gathered by partition (a large partition is split over tasks)."""
        parts = [f.name for f in self.parts]
        rows = rows.select(*self.columns, *parts)
        w = (rows.hint("rebalance", *parts) if parts else rows).write.mode("overwrite")
        (w.partitionBy(*parts) if parts else w).parquet(self.folder(batch))

    def read(self, but: str | None = None) -> DataFrame:
        """All rows of committed batches (``but`` one left out) with their partition columns and ``batch``."""
        batches = [b for b in self.committed() if b != but]
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.read_batches(batches)

    def read_batches(self, batches: list[str]) -> DataFrame:
        return (self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[self.folder(b) for b in batches]))

    def remove(self, path: str) -> None:
        fs, at = self._fs(path)
        fs.delete(at, True)


class KeyedTable:
    """A canonical table into which a key gets once.

    Rows are partitioned by ranges of ``width`` values of the first key column, so a key is always looked for in one
    range: a batch reads the ranges it touches and nothing else (partition filters).  Ids that a counter
    hands out put a day's batch into the last ranges."""

    def __init__(self, spark: SparkSession, path: str, table: str, columns: list[str] = (), width: int = 1_000_000):
        schema = schema_of(table, columns)
        self.table, self.key, self.width = table, key_of(table, columns), width
        self.rows = BatchStore(spark, f"{path.rstrip('/')}/rows", schema, [T.StructField("key_range", T.LongType())])
        report = T.StructType([*[schema[k] for k in self.key], T.StructField("reason", T.StringType()), T.StructField("rows", T.LongType())])
        self.refused_rows = BatchStore(spark, f"{path.rstrip('/')}/refused", report)

    def read(self) -> DataFrame:
        """The table as declared."""
        return self.rows.read().select(*self.rows.columns)

    def known_keys(self, ranges: list[int], batch: str) -> DataFrame:
        """The keys of other batches in these key ranges."""
        return self.rows.read(but=batch).where(F.col("key_range").isin(ranges)).select(*self.key)

    def append(self, rows: DataFrame, batch: str) -> DataFrame:
        """Add the rows of ``batch`` whose key is new; returns the refused ones: the key, ``reason``, ``rows``.

        A key that the table has from another batch is refused ("key exists"), so is a NULL in the key ("key is null").  Of
        several rows with one key in the batch the least (compared column by column) gets in, the others
        are refused ("key repeated").  The batch is first reduced to a row for each key (map-side, so a key that a third
        of the rows repeat loads no task) and staged; the write of its folder is the commit."""
        cols = self.rows.columns
        stage = f"{self.rows.path}/_stage/{batch}"
        reduced = conform(rows, self.table).groupBy(*self.key).agg(F.min(F.struct(*cols)).alias("row"), F.count(F.lit(1)).alias("n"))
        reduced.withColumn("key_range", F.floor(F.col(self.key[0]) / self.width).cast("long")).write.mode("overwrite").parquet(stage)
        staged = self.rows.spark.read.parquet(stage)
        ranges = [r[0] for r in staged.select("key_range").where("key_range is not null").distinct().collect()]
        known = self.known_keys(ranges, batch).distinct().withColumn("known", F.lit(True))
        both = staged.join(known, self.key, "left").withColumn("null_key", _any_null(self.key))
        new = both.where("known is null and not null_key")
        refused = both.select(*self.key, F.when(F.col("null_key"), "key is null").when(F.col("known"), "key exists").otherwise("key repeated").alias("reason"),
                              (F.col("n") - F.when(F.col("null_key") | F.col("known"), 0).otherwise(1)).alias("rows"))
        self.refused_rows.write(refused.where("rows > 0"), batch)
        self.rows.write(new.select("row.*", "key_range"), batch)
        self.rows.remove(stage)
        return self.refused(batch)

    def refused(self, batch: str) -> DataFrame:
        """What ``append`` refused of a batch."""
        return self.refused_rows.read().where(F.col(BATCH) == batch).select(*self.refused_rows.columns)


def _any_null(columns: list[str]) -> Column:
    out = F.col(columns[0]).isNull()
    for c in columns[1:]:
        out |= F.col(c).isNull()
    return out
