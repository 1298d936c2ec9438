"""Byte n-grams of many texts at once, bounded labelled samples, and fits away from the driver."""

from __future__ import annotations

import importlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, forget, remote, written

#: Bytes of text that are turned into arrays at once, and the most texts.
BLOCK, MOST_TEXTS = 1 << 20, 4096


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text stands alone."""
    start = total = 0
    for k, t in enumerate(texts):
        if total and total + len(t) > size or k - start == MOST_TEXTS:
            yield start, k
            start = k
            total = 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def joined(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array, ``gap`` blanks after each; and where each starts, with the end."""
    pad = b" " * gap
    starts = np.cumsum([0, *(len(t) + gap for t in texts)])
    return np.frombuffer(pad.join(texts) + pad, np.uint8), starts


def gram_codes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n-gram at each place but the last n - 1."""
    size = max(0, len(data) - n + 1)
    code = np.full(size, np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF), np.uint32)
    for k in range(n):
        code ^= data[k : k + size]
        code *= np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    return (code >> np.uint32(32 - bits)).astype(np.int32)


def within(rows: list[tuple[int, int, int]], most: int) -> list[int]:
    """Which of ``rows`` (order, bytes, key) to learn from: in order, each that still fits into
    ``most`` bytes. The shortest is always taken, so that no class goes without an example."""
    out, left = [], most
    for _, size, key in sorted(rows):
        if size <= left:
            out.append(key)
            left -= size
    return out or [min(rows, key=lambda r: (r[1], r[0]))[2]]


def sample(docs: DataFrame, known: DataFrame, kind: str, sizes: dict, per_class: int, class_bytes: int, salt: str) -> DataFrame:
    """(doc_id, text, kind) to learn from: of each class about ``per_class`` ids at most, drawn by
    hash of the id, and ``class_bytes`` bytes of text (``within``).

    known: (doc_id, kind), an id once. sizes: how many ids each class has. An id with
    several texts teaches with one, that of the least hash; null texts teach nothing.
    Ids and sizes of the drawn rows, a number of rows that the parameters bound, meet on
    the driver; texts do not.
    """
    draw = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_class / max(1, n)))])
    drawn = known.where(draw < share[F.col(kind)]).withColumn("_order", F.xxhash64(F.lit(salt), "doc_id"))
    # about per_class ids a class at most, whatever the input's size
    met = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")
    one = met.groupBy("doc_id", kind, "_order").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("t"))
    rows = written(one.select("doc_id", F.col("t.text").alias("text"), F.octet_length("t.text").alias("_size"), kind, "_order", F.monotonically_increasing_id().alias("_row")), "sample")
    by: dict = {}
    for r in rows.select(kind, "_order", "_size", "_row").toLocalIterator():
        by.setdefault(r[0], []).append((r[1], r[2], r[3]))
    chosen = [key for found in by.values() for key in within(found, class_bytes)]
    ids = docs.sparkSession.createDataFrame([(x,) for x in chosen], "_row long")
    return rows.join(F.broadcast(ids), "_row", "left_semi").select("doc_id", "text", kind).orderBy("doc_id")


def fit_batches(batches, fits: str, kind: str):
    texts: list[str] = []
    kinds: list = []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        kinds += batch.column(kind).to_pylist()
    model = importlib.import_module(fits).fit(texts, kinds)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model, 5)], pa.binary())], ["model"])


def fitted(rows: DataFrame, module: str, kind: str) -> object:
    """The model that ``module.fit`` makes of the sample, in one task on an executor: the driver
    gets the model alone. A sample without rows has no task, and is fitted here."""
    bound_batches(rows.sparkSession)
    one = rows.coalesce(1).mapInArrow(remote(__name__, "fit_batches", fits=module, kind=kind), "model binary")
    found = one.first()
    return pickle.loads(found[0]) if found else importlib.import_module(module).fit([], [])


def labelled(docs: DataFrame, labels: DataFrame, label: str, kept: Column, per_class: int, class_bytes: int) -> DataFrame | None:
    """A sample of both classes of ``label`` (0, 1) outside the held-out fold; None without labels.
    Rows with a null label are passed over; several labels of an id count as the largest."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_label")).where(kept)
    sizes = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    return sample(docs, known, "_label", sizes, per_class, class_bytes, "draw") if sizes else None


def longer(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` and more fields; no name is quoted anywhere, so any name will do."""
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])
