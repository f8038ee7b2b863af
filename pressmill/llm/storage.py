"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's setting spark.checkpoint.dir.  Where it is unset, a temporary folder with a local master (tests on one machine), and an error with any other."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pressmill.shared.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pressmill-")
        spark.conf.set("pressmill.shared.dir", d)
    return d


def place(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared folder, so that a lost executor loses none of it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def store(df: DataFrame, path: str) -> DataFrame:
    """df written at path in the shared folder, compressed, and read from there.  The shuffle files of its computation go as soon as it is written, so that a job's steps don't add up on the executors' disks."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what store wrote, when nothing computed from it is needed any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def file_system(folder: str):
    """pyarrow's file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have (in any case), one for each of names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__pm_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out
