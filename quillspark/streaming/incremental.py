"""File-source streams that do what repeated batch runs with caches do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def changed_pages(spark: SparkSession, root: str) -> DataFrame:
    """A stream of (path, content, sha256) of new or rewritten Markdown files under a folder."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.sha2(F.col("value").cast("binary"), 256).alias("sha256"))


def refresh(pages: DataFrame, cache_path: str, checkpoint: str, handle: Callable[[DataFrame], None]) -> StreamingQuery:
    """Runs ``handle`` on the pages of each batch whose hash is not in the cache of processed pages, then appends them to it.

    The cache is a Parquet folder that only this query writes. A batch that is run
    again after a failure finds its pages in the cache if it got as far as that, and
    handles them again if not.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        known = spark.read.schema("path string, sha256 string").parquet(cache_path) if _exists(spark, cache_path) else spark.createDataFrame([], "path string, sha256 string")
        # the fresh rows are needed twice, before and after the cache grows
        fresh = df.join(known, ["path", "sha256"], "left_anti").persist()
        handle(fresh)
        fresh.select("path", "sha256").write.mode("append").parquet(cache_path)
        fresh.unpersist()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_hits(hits: DataFrame, key: str, delay: str | None = None, time: str | None = None) -> DataFrame:
    """A stream of hits, each key once; with ``time`` and ``delay`` state older than the watermark is dropped."""
    if time and delay:
        return hits.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return hits.dropDuplicates([key])


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
