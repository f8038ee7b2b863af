"""The folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's setting spark.checkpoint.dir.  Where it is unset, a temporary folder with a local master (tests on one machine), and an error with any other."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pressmill.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="pressmill-")
        spark.conf.set("pressmill.shared.dir", found)
    return found


def keep(frame: DataFrame) -> DataFrame:
    """frame computed once and written to the shared folder, so that what is built on it neither computes it again nor loses it with an executor."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(frame.sparkSession))
    return frame.checkpoint(eager=True)
