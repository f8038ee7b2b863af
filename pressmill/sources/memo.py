"""Memos and caches as Parquet tables, by domain."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.operators import discover

SCHEMA = "domain string, url string"
#: So many versions stay, for readers that began before the last one was written.
KEPT = 3


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions of the memo, oldest first; none before the first.  Whatever else keeps the folder from being listed raises."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    if not system.exists(where):
        return []
    names = [f.getPath().getName() for f in system.listStatus(where)]
    return sorted(n for n in names if n.startswith("v-") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))  # noqa: SLF001


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The memo's latest complete version; empty before the first."""
    versions = _versions(spark, folder)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/{versions[-1]}") if versions else spark.createDataFrame([], SCHEMA)


def _write(spark: SparkSession, folder: str, memo: DataFrame) -> None:
    """A new version beside the old ones: it counts from the moment that it is complete, so that a failed write loses nothing.  All but the last KEPT versions go."""
    before = _versions(spark, folder)
    number = int(before[-1].split("-")[1]) + 1 if before else 0
    memo.write.parquet(f"{folder}/v-{number:012d}-{uuid.uuid4().hex[:8]}")
    for old in before[: 1 - KEPT]:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}")  # noqa: SLF001
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def update(spark: SparkSession, folder: str, seen: DataFrame, most: int = discover.MOST_MEMO) -> None:
    """Writes a new version of the memo with the URLs seen; readers of the one before aren't disturbed.  One writer at a time."""
    _write(spark, folder, discover.remember(read(spark, folder), seen, most))


def clear(spark: SparkSession, folder: str, domain: str) -> None:
    """Forgets a domain."""
    _write(spark, folder, discover.forget(read(spark, folder), domain))


def write_cache(frame: DataFrame, folder: str) -> None:
    """Adds rows with the time of computing to a cache table; discover.cached reads it with an age limit."""
    frame.withColumn("computed_at", F.current_timestamp()).write.mode("append").parquet(folder)
