"""Sharding by longest-processing-time scheduling: groups that must stay together, sorted by
size, go to the least-loaded shard through a heap (law ``bytes``: shard sizes near equal).

Scheduled at two levels, so that neither a task nor the driver holds all groups.  Groups are dealt by hash
to about sqrt(groups) buckets (``BUCKETS`` at most); in each bucket they go, largest first, to the least
loaded of ``BINS`` bins.  The bins of all buckets, ``BUCKETS * BINS`` numbers at most, then go, largest first,
to the least loaded shard.  Shards differ by about the size of the smallest bins, unless a single group
is larger than a shard's share.

Every row gets a slot, gapless from 0 in its shard: rows are dealt by a hash of id, size and checksum to pieces of each
shard, numbered inside a piece, and moved up by the sizes of the pieces before it.

A group may hold a third of all rows: sizes are pre-aggregated map-side, the rows meet their group's shard in
a salted join, and slots don't depend on groups.

Cases: a null text has size 1 and the checksum of no bytes, and null texts are one group (apart from empty ones);
repeated rows are rows of one group, each with a slot; rows of one size and group differ in the slot only; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm.common import materialize, salted_join

SHARDS = 8
#: Buckets of the first level, at most, and bins of each.
BUCKETS, BINS = 16_384, 64


def least_loaded(sizes: list[tuple], bins: int) -> list[int]:
    """A bin for each item of (size, name): by size, largest first, each to the least loaded bin."""
    heap, out = [(0, b) for b in range(bins)], [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k][0], sizes[k][1:])):
        load, b = heap[0]
        heapq.heapreplace(heap, (load + sizes[k][0], b))
        out[k] = b
    return out


def pack(groups: DataFrame, shards: int) -> DataFrame:
    """``g1``, ``g2``, ``shard`` for every group of ``g1``, ``g2``, ``bytes``."""
    spark = groups.sparkSession
    groups = materialize(groups)
    n = groups.count()
    buckets = max(1, min(BUCKETS, math.ceil(math.sqrt(n))))

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame["bin"] = least_loaded(list(zip(frame["bytes"].tolist(), frame["g1"].tolist(), frame["g2"].tolist())), BINS)
        return frame

    schema = "g1 long, g2 long, bytes long, bucket int, bin int"
    dealt = materialize(groups.withColumn("bucket", F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets)).cast("int"))
                        .select("g1", "g2", "bytes", "bucket").groupBy("bucket").applyInPandas(lambda f: deal(f)[["g1", "g2", "bytes", "bucket", "bin"]], schema))
    bins = [(r["bytes"], r["bucket"], r["bin"]) for r in dealt.groupBy("bucket", "bin").agg(F.sum("bytes").alias("bytes")).collect()]
    kind = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("shard", T.IntegerType())])
    of_bin = spark.createDataFrame([(b, k, s) for (_, b, k), s in zip(bins, least_loaded(bins, shards))], kind)
    return dealt.join(of_bin, ["bucket", "bin"]).select("g1", "g2", "shard")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` for every row; equal texts share a shard."""
    text = F.col(text_col).cast("string")
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("g"), text, text.isNull()).alias("g2")))
    shard_of = pack(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")), shards)
    pieces = max(1, math.ceil(math.sqrt(rows.count())))
    placed = salted_join(rows, shard_of, ["g1", "g2"], ["id", "size"]).drop("g1", "g2")
    # Pieces by the whole row, so that rows without an id, or of one id, don't meet in one piece.
    of_row = F.xxhash64(F.col("id").cast("string"), F.lit("slot"), "size", "text_crc32")
    placed = materialize(placed.withColumn("piece", F.pmod(of_row, F.lit(pieces)).cast("int")))
    # One row for each piece of each shard: a short table, whatever the number of rows.
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    nth = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("id", "size", "text_crc32")) - 1
    return (placed.withColumn("nth", nth).join(starts, ["shard", "piece"])
            .select("id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot")))
