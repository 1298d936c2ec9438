"""Operator 2: token ids as ORC, in stripes with integer run-length encoding.

Rows stand in ascending doc_id order over the files. Every file has row indexes and a
Bloom filter on doc_id, so a reader skips stripes and row groups by id, reads stripes in
parallel, and reads lengths without touching the ids.

A row holds doc_id, part (the file's place in the order), local_start (ids before the
document in its file), n_tokens (with the end id) and ids. Where a document starts in the
whole store is local_start plus the lengths of the files before it, which
``with_starts`` takes from the small columns of the files alone.

Defined cases: a null text counts as empty and has only the end id; rows with a null id
come first; rows that share an id stand together, ordered by their text's hash; an empty
table gives a store without rows; other columns of the input are not stored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe
from .common import bound_batches, remote, scratch_path, texts_of

END = 2
COLUMNS = "doc_id bigint, part int, local_start bigint, n_tokens int, ids array<int>"
OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def store_batches(batches, path: str, end: int):
    """Ids of each document with the end id, and its place in this partition's file."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    known, stop, start = bpe.memo(path, "bytes"), np.array([end], "<u4").tobytes(), 0
    for batch in batches:
        raw = [b"".join([*p, stop]) for p in known.parts(texts_of(batch.column("text")))]
        n = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
        starts = start + np.cumsum(n) - n
        start += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n.astype(np.int32)), bpe.id_list(raw)],
            ["doc_id", "part", "local_start", "n_tokens", "ids"],
        )


def checksum_batches(batches):
    """crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], [*batch.schema.names[:-1], "ids_crc32"])


def write_store(docs: DataFrame, path: str, end: int = END, folder: str | None = None) -> None:
    """Writes the ids of ``docs`` to ``path``. One shuffle, of the texts by range of doc_id;
    the text's hash in the range key lets a hot id spread over files."""
    bound_batches(docs.sparkSession)
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
    )
    rows = ordered.mapInArrow(remote(__name__, "store_batches", path=bpe.vocabulary_path(bpe.VOCABULARY, folder), end=end), COLUMNS)
    rows.write.mode("overwrite").options(**OPTIONS).orc(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents: the ids reach the reader, which skips by index and filter."""
    return read_store(spark, path).where(F.col("doc_id").isin(doc_ids))


def with_starts(store: DataFrame) -> DataFrame:
    """The store's rows with ``start``. Lengths are summed by file first; only those sums, a
    row a file, meet in one task."""
    sizes = store.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    offset = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("part"), offset.alias("file_start"))
    return store.join(offsets, "part").withColumn("start", F.col("file_start") + F.col("local_start")).drop("file_start")


def checksums(store: DataFrame) -> DataFrame:
    """The store's rows with ids_crc32 in place of the ids."""
    bound_batches(store.sparkSession)
    plain = store.select("doc_id", "part", "local_start", "n_tokens", "ids")
    return plain.mapInArrow(remote(__name__, "checksum_batches"), "doc_id bigint, part int, local_start bigint, n_tokens int, ids_crc32 bigint")


def store_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the store, reads it back, and describes each document from the files."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-store")
    write_store(docs, path)
    return with_starts(checksums(read_store(spark, path))).select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
