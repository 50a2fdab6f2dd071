"""Session helpers for tests, the bench and local runs.

Library functions never create sessions; they take DataFrames.  On a cluster the
caller's session is used as is.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shopmetrics") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHOPMETRICS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def runtime_filters(spark: SparkSession, keys: int, false_positives: float = 0.03) -> None:
    """Let joins with a filtered side (completed orders in R4, R5, R5p, R2) thin the other side before its shuffle.

    Spark builds a Bloom filter of the filtered side's keys while the query runs and tests the large side's rows in their scan.
    ``keys``: how many keys to size it for, e.g. the orders counted by ``sources.footers.row_counts``; at 3 % false positives a
    filter takes about 7.3 bits a key, and Spark's ceiling is raised to that."""
    bits = max(1 << 20, math.ceil(-keys * math.log(false_positives) / math.log(2) ** 2))
    for k, v in {"enabled": "true", "expectedNumItems": str(keys), "maxNumItems": str(max(keys, 4_000_000)), "numBits": str(bits),
                 "maxNumBits": str(max(bits, 67_108_864)), "creationSideThreshold": "10g", "applicationSideScanSizeThreshold": "0"}.items():
        spark.conf.set(f"spark.sql.optimizer.runtime.bloomFilter.{k}", v)
