"""The memo on streams: URLs pass once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pressmill.functions import urls
from pressmill.operators import discover


def new_articles(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Rows of a stream of (url, time) that look like articles, the first of each URL; what comes later than delay is dropped, and state is kept no longer."""
    valid = stream.where(urls.valid_article_url(F.col("url"))).withColumn("domain", urls.domain(F.col("url")))
    return valid.withWatermark(time, delay).dropDuplicatesWithinWatermark(["domain", "url"])


def arrivals(stream: DataFrame, time: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts by window and domain, late rows up to delay included."""
    return stream.withColumn("domain", urls.domain(F.col("url"))).withWatermark(time, delay).groupBy(F.window(time, window), "domain").count()


def into_memo(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream of (source_url, url) into the memo table at folder, a batch at a time; a repeated batch changes nothing."""
    from pressmill.sources import memo

    def write(batch: DataFrame, _: int) -> None:
        seen = batch.select(urls.domain(F.col("source_url")).alias("domain"), "url").distinct()
        memo.update(batch.sparkSession, folder, seen, discover.MOST_MEMO)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
