"""Where results and archives go."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

RESULT_COLUMNS = ["timestamp", "message", "orig_file_path", "archive_id", "log_event_ix"]


def to_lines(df: DataFrame) -> Iterator[str]:
    """Messages one by one, a partition at a time."""
    return (r["message"] for r in df.select("message").toLocalIterator())


def to_files(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """The five result columns as files."""
    df.select(*RESULT_COLUMNS).write.mode("overwrite").format(kind).save(path)


def to_network(df: DataFrame, send: Callable[[Iterator[Row]], None]) -> None:
    """Each partition's rows to ``send``, where the partition is; a retried partition is sent
    again, so the receiver should know a row by archive_id and log_event_ix."""
    df.select(*RESULT_COLUMNS).foreachPartition(send)


def to_results(df: DataFrame, path: str, k: int, dataset: str = "") -> None:
    """The newest k results as a table that ``read_results`` reads."""
    newest = df.orderBy(F.desc_nulls_last("timestamp"), "archive_id", "log_event_ix").limit(k)
    identity = F.concat_ws("-", "archive_id", "log_event_ix")
    newest.select(identity.alias("id"), *RESULT_COLUMNS, F.lit(dataset or None).cast("string").alias("dataset")).write.mode("overwrite").parquet(path)


def tagged(aggregate: DataFrame, archive_id: str) -> DataFrame:
    """Aggregation documents with the archive they are of."""
    return aggregate.withColumn("archive_id", F.lit(archive_id))


def write_archive(df: DataFrame, path: str, order: str | None = None, partition_by: list[str] = (), records_per_file: int = 0, bloom_columns: list[str] = ()) -> None:
    """Columnar files, zstd-compressed: ranged by ``order`` so that their statistics prune, and
    with Bloom filters where asked."""
    if order:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    writer = df.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "v2")
    if records_per_file:
        writer = writer.option("maxRecordsPerFile", records_per_file)
    for c in bloom_columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def extract(df: DataFrame, path: str, json_column: str = "record", order: str | None = None) -> None:
    """Records as JSON lines again; with ``order``, in log order over the files."""
    if order:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    df.select(F.to_json(json_column).alias("value")).write.mode("overwrite").text(path)


def extract_stream(archive: DataFrame, path: str, file: str, begin_ix: int | None = None, end_ix: int | None = None) -> None:
    """One original file's messages between two indexes, in order, for a viewer."""
    part = archive.where(F.col("orig_file_path") == file)
    if begin_ix is not None:
        part = part.where(F.col("log_event_idx") >= begin_ix)
    if end_ix is not None:
        part = part.where(F.col("log_event_idx") < end_ix)
    part.repartitionByRange("log_event_idx").sortWithinPartitions("log_event_idx").select("message").write.mode("overwrite").text(path)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """Distinct templates or variables, with how often each occurs."""
    return df.groupBy(column).agg(F.count("*").alias("count"))


def size_of(column: Column) -> Column:
    """Bytes of a message."""
    return F.octet_length(column)
