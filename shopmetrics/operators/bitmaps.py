"""Exact distinct counts that can be merged: bitmaps of whole numbers.

A set of numbers is one bitmap of 32,768 bits for each bucket of numbers it has members in; sets are united by OR and
counted by their bits, so counts of days, devices or channels merge without the rows they came from.  The numbers
should be dense (ids a counter hands out): a bitmap takes 4 KB however few of its bits are set.  ``number_keys`` gives
dense numbers to any keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET, BITS = "bucket", "bits"


def bitmaps_of(rows: DataFrame, dims: Sequence[str], number: str) -> DataFrame:
    """``dims``, bucket, bits: the numbers of each group.  A NULL number sets no bit but keeps its group (bucket NULL)."""
    return rows.groupBy(*dims, F.bitmap_bucket_number(number).alias(BUCKET)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias(BITS))


def united(bitmaps: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The union of the sets of each group of ``dims`` (ORed map-side: a bitmap for each bucket and task is shuffled)."""
    return bitmaps.groupBy(*dims, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def members(bitmaps: DataFrame, dims: Sequence[str], name: str) -> DataFrame:
    """``dims`` and the exact size of each group's set."""
    return united(bitmaps, dims).groupBy(*dims).agg(F.sum(F.bitmap_count(BITS)).alias(name))


def number_keys(keys: DataFrame, key: str, numbered: DataFrame | None = None) -> DataFrame:
    """``key``, ``number``: dense numbers from 1 for the distinct keys; those of ``numbered`` keep theirs, and new keys
    get the numbers after them.

    Keys are dealt to partitions by hash and numbered there; the driver sees one count for each partition."""
    new = keys.select(key).where(F.col(key).isNotNull()).distinct()
    start = 0
    if numbered is not None:
        new = new.join(numbered, key, "left_anti")
        start = numbered.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    dealt = new.withColumn("part", part)
    sizes = dict(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], start
    for p in range(n):
        offsets.append(total)
        total += sizes.get(p, 0)
    place = F.row_number().over(Window.partitionBy("part").orderBy(key))
    out = dealt.select(key, (F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("part")) + place).alias("number"))
    return out if numbered is None else numbered.select(key, "number").unionByName(out)
