"""Continuous ingestion: files become archives in micro-batches, by size or by time."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> DataFrame:
    """New files under a folder, local or in an object store; the checkpoint remembers which are done."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.load(path)


def ingest(stream: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Archives of each batch. A batch that is tried again overwrites its own folder, so nothing
    is stored twice. Without ``every`` it takes what is there and ends, as a flush does."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    return writer.trigger(processingTime=every).start() if every else writer.trigger(availableNow=True).start()


@dataclass
class Buffer:
    """Object metadata waiting to be stored: it flushes when its size reaches a bound, or its
    oldest entry's age does (entries that come later don't put that off), and on closing."""

    max_bytes: int
    max_age_s: float
    flush: Callable[[list[tuple[str, int]]], None]
    clock: Callable[[], float] = time.monotonic
    entries: list[tuple[str, int]] = field(default_factory=list)
    size: int = 0
    oldest: float | None = None

    def add(self, name: str, size: int) -> None:
        if self.oldest is None:
            self.oldest = self.clock()
        self.entries.append((name, size))
        self.size += size
        if self.size >= self.max_bytes:
            self.out()

    def tick(self) -> None:
        if self.oldest is not None and self.clock() - self.oldest >= self.max_age_s:
            self.out()

    def out(self) -> None:
        if self.entries:
            self.flush(self.entries)
        self.entries, self.size, self.oldest = [], 0, None

    close = out


def group_files(files: DataFrame, target_bytes: int) -> DataFrame:
    """(path, size) with the partition of each: files of like names (digits aside) go together,
    into partitions of about the target size. Sizes run within a name's group."""
    from pyspark.sql.window import Window

    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\d+", "#")
    grouped = files.withColumn("name_group", name)
    order = Window.partitionBy("name_group").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.withColumn("part", F.floor(F.coalesce(F.sum("size").over(order), F.lit(0)) / target_bytes).cast("long"))


def scan_prefix(files: DataFrame, after: str | None) -> DataFrame:
    """Objects past the last key that was seen, in key order."""
    return (files if after is None else files.where(F.col("path") > after)).orderBy("path")
