"""Searches and timelines over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..kql.compile import compile_query


def search_stream(stream: DataFrame, query: str, **options) -> DataFrame:
    """The rows of a stream that match; the same expression as over a table, so paths for key
    wildcards must be given."""
    return stream.where(compile_query(stream, query, **options))


def counts(stream: DataFrame, column: str, size: str, late: str) -> DataFrame:
    """{timestamp, count} of tumbling windows; the watermark bounds the state to what may still change."""
    windows = stream.withWatermark(column, late).groupBy(F.window(column, size).alias("w")).agg(F.count("*").alias("count"))
    return windows.select((F.unix_micros("w.start") / 1000).cast("long").alias("timestamp"), "count")


def publish(timeline: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Only changed buckets go out with each batch, as a folder of its own; ``latest`` reads the
    newest count of each. Tried again, a batch overwrites its folder."""

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = timeline.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


def latest(spark, target: str) -> DataFrame:
    """{timestamp, count} as of the newest batch that changed each bucket."""
    return spark.read.parquet(target).groupBy("timestamp").agg(F.max_by("count", "version").alias("count"))
