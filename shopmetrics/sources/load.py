"""Loading CSV exports past bad records (IO3): good rows and rejects from one scan.

Every record is read as text and cast once to the declared schema.  A record that doesn't fit is kept as it stands, with the
column and the reason.  Both kinds leave the scan in one write, partitioned by ``rejected``, and the counts are
observed by the same job, so a load reads its files once and accounts for every record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.model import CHECKS, HEADER_NAMES, required, schema_of

#: Column of a record that has more or fewer fields than the header.
CORRUPT = "_corrupt_record"
REJECT = T.StructType([T.StructField("column", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("record", T.StringType())])


@dataclass(frozen=True)
class Loaded:
    """A finished load: its folder, the table's schema, and how many records were accepted and rejected."""

    spark: SparkSession
    path: str
    schema: T.StructType
    accepted: int
    rejected: int

    def _part(self, rejected: bool, schema: T.StructType) -> DataFrame:
        if not (self.rejected if rejected else self.accepted):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/rejected={str(rejected).lower()}")

    def rows(self) -> DataFrame:
        """The good rows, as declared."""
        return self._part(False, T.StructType([T.StructField(f.name, f.dataType) for f in self.schema]))

    def rejects(self) -> DataFrame:
        """column (NULL for a record that isn't whole), reason, record (the fields as CSV)."""
        return self._part(True, REJECT)


def read_records(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """The records of CSV files with a header, all fields text, and ``CORRUPT``.  ``multiline`` allows line breaks in
    quotes, which takes a file whole into one task; without it files are split."""
    def reader():
        return (spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multiline).option("escape", '"')
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))

    names = reader().csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    return reader().schema(schema).csv(path)


def checked(records: DataFrame, table: str) -> DataFrame:
    """The declared columns of ``table``, ``column`` and ``reason`` of the first fault of a record (NULL if it has none), ``record``."""
    names = [c for c in records.columns if c != CORRUPT]
    renamed = {a: b for a, b in HEADER_NAMES.get(table, {}).items() if a in names and b not in names}
    of = {renamed.get(c, c): c for c in names}
    schema = schema_of(table, of)
    missing = [c for c in required(table, of) if c not in of]
    if missing:
        raise ValueError(f"{table}: no column {', '.join(missing)} in the source (it has {', '.join(names)})")
    allowed = {c: values for t, c, values in CHECKS if t == table}
    fault: Column = F.when(F.col(CORRUPT).isNotNull(), _fault(None, F.lit("not as many fields as the header")))
    values = []
    for f in schema.fields:
        if f.name not in of:
            values.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        text = F.col(f"`{of[f.name]}`")
        value = text.try_cast(f.dataType)
        fault = fault.when(text.isNotNull() & value.isNull(), _fault(f.name, F.concat(F.lit(f"cannot read as {f.dataType.simpleString()}: "), text)))
        if f.name in required(table, of):
            fault = fault.when(text.isNull(), _fault(f.name, F.lit("no value")))
        if f.name in allowed:
            fault = fault.when(~text.isin(*allowed[f.name]), _fault(f.name, F.concat(F.lit("not an allowed value: "), text)))
        values.append(value.alias(f.name))
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names])))
    out = records.select(*values, fault.alias("fault"), record.alias("record"))
    return out.select(*schema.names, "fault.column", "fault.reason", F.when(F.col("fault").isNotNull(), F.col("record")).alias("record"))


def _fault(column: str | None, reason: Column) -> Column:
    return F.struct(F.lit(column).cast("string").alias("column"), reason.alias("reason"))


def load_csv(spark: SparkSession, path: str, table: str, out: str, multiline: bool = True) -> Loaded:
    """Load the CSV files at ``path`` into the folder ``out`` (replaced as a whole): good rows and rejects in one write."""
    rows = checked(read_records(spark, path, multiline), table)
    schema = schema_of(table, rows.columns)
    seen = Observation("load")
    bad = F.col("reason").isNotNull()
    rows = rows.withColumn("rejected", bad).observe(seen, F.count(F.when(~bad, 1)).alias("accepted"), F.count(F.when(bad, 1)).alias("rejected"))
    rows.write.mode("overwrite").partitionBy("rejected").parquet(out)
    return Loaded(spark, out, schema, seen.get["accepted"], seen.get["rejected"])
