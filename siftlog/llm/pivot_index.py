"""Operator 3: near-duplicate embeddings by a pivot-permutation index.

Reference points are drawn from the data, about PIVOT_ROOT times the square root of the rows,
and thinned so that no two are of cosine APART or more: else a large group of near copies
would hold many pivots of its own, which its members rank by noise alone.
A vector is described by its PREFIX nearest ones in order, and stands in the inverted list
of each of them, within its label. Vectors of a list that share at least SHARED pivots (all,
where there are fewer) are candidates, and their cosine in double precision decides. A pair is settled in the list
of the least pivot it shares, so none counts twice.

Equal vectors of a label are one entry with a multiplicity. Lists of over BLOCK entries are
cut into blocks, and each pair of blocks is a task's group of its own, so a hot list is
spread and still compared whole. A group gives the number of links of each vector and a
spanning forest, never the pairs.

The index is approximate; ``tests/llm`` measures its recall against brute force. Defined
cases: null, zero and empty vectors, vectors with null or non-finite components and rows
with a null label link with nothing; vectors of different lengths are never compared; null
ids get a null component; an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, connected_components, remote, written
from .simhash_trie import forest

COSINE = 0.93
PIVOT_ROOT = 2.0
MOST_PIVOTS = 1 << 16
PREFIX = 10
SHARED = 2
BLOCK = 1024
#: Pivots are less alike than this.
APART = 0.86


def pivots(vectors: DataFrame, rows: int) -> np.ndarray:
    """Unit vectors, drawn by hash; how many follows the number of rows and is bounded."""
    want = int(max(PREFIX, min(MOST_PIVOTS, math.ceil(PIVOT_ROOT * math.sqrt(max(rows, 1))))))
    drawn = vectors.select("unit").distinct().orderBy(F.xxhash64("unit"), "unit").limit(want).collect()
    return thinned(np.array([r["unit"] for r in drawn], np.float64))


def thinned(points: np.ndarray) -> np.ndarray:
    """``points`` in their order, less those of cosine APART or more to one that stays."""
    kept = np.empty_like(points)
    count = 0
    for x in points:
        if not (kept[:count] @ x >= APART).any():
            kept[count] = x
            count += 1
    return kept[:count].copy()


def prefix_batches(batches, points):
    """Numbers of the nearest pivots, nearest first, of every unit vector."""
    table = points.value
    k = min(PREFIX, len(table))
    for batch in batches:
        x = np.array(batch.column("unit").to_pylist(), np.float64).reshape(-1, table.shape[1])
        near = np.empty((len(x), k), np.int32)
        for at in range(0, len(x), 256):
            likeness = x[at : at + 256] @ table.T
            top = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
            order = np.argsort(-np.take_along_axis(likeness, top, 1), axis=1, kind="stable")
            near[at : at + 256] = np.take_along_axis(top, order, 1)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, k, dtype=np.int32)), pa.array(near.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, flat], [*batch.schema.names, "prefix"])


def block_links(table: pa.Table, limit: float) -> pa.Table:
    """Links within one block, or between two, of an inverted list."""
    pivot = table.column("pivot")[0].as_py()
    side = table.column("side").to_numpy()
    same = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
    ids = table.column("entry").to_numpy()
    many = table.column("rows").to_numpy()
    unit = np.array(table.column("unit").to_pylist(), np.float64)
    prefix = np.array(table.column("prefix").to_pylist(), np.int64)
    left = np.arange(len(ids)) if same else np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    n_links = np.zeros(len(ids), np.int64)
    low: list[int] = []
    high: list[int] = []
    # a column for each pivot that two of them or more have; products count what is shared
    names, column, seen = np.unique(prefix, return_inverse=True, return_counts=True)
    hot = np.zeros((len(ids), len(names)), np.float32)
    hot[np.arange(len(ids))[:, None], column.reshape(prefix.shape)] = 1
    hot, names = hot[:, seen > 1], names[seen > 1]
    lower = hot[:, names < pivot]
    peers, lower_peers = hot[right].T.copy(), lower[right].T.copy()
    for at in range(0, len(left), 128):
        a = left[at : at + 128]
        # where hardly a pivot is left all vectors are neighbours; a pair belongs to its least pivot's list
        near = (hot[a] @ peers >= min(SHARED, prefix.shape[1])) & (lower[a] @ lower_peers == 0)
        if same:
            near &= (at + np.arange(len(a)))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(near)
        for cut in range(0, len(i), 1 << 15):
            x, y = a[i[cut : cut + (1 << 15)]], right[j[cut : cut + (1 << 15)]]
            ok = np.einsum("ij,ij->i", unit[x], unit[y]) >= limit
            x, y = x[ok], y[ok]
            np.add.at(n_links, x, many[y])
            np.add.at(n_links, y, many[x])
            for p, q in forest(zip(x.tolist(), y.tolist()), len(ids)) if len(x) else ():
                low.append(p)
                high.append(q)
    edges = forest(zip(low, high), len(ids))
    counted = np.flatnonzero(n_links)
    return pa.table(
        {
            "entry": pa.array([*ids[counted].tolist(), *(int(ids[p]) for p, _ in edges)], pa.int64()),
            "links": pa.array([*n_links[counted].tolist(), *[0] * len(edges)], pa.int64()),
            "other": pa.array([*[None] * len(counted), *(int(ids[q]) for _, q in edges)], pa.int64()),
        }
    )


def block_function(limit: float):
    root = __import__("siftlog.llm.common", fromlist=["_ROOT"])._ROOT
    module = __name__

    def run(table):
        import importlib
        import sys

        try:
            found = importlib.import_module(module)
        except ModuleNotFoundError as error:
            if not module.startswith(error.name or "?"):
                raise
            sys.path.insert(0, root)
            found = importlib.import_module(module)
        return found.block_links(table, limit)

    return run


def near_vectors(table: DataFrame, limit: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding, label)."""
    spark = table.sparkSession
    bound_batches(spark, 4096)
    x = F.transform("embedding", lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    sound = F.col("embedding").isNotNull() & F.col("label").isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # huge and tiny components are brought into range before they are squared
    peak = F.array_max(F.transform(x, F.abs))
    scaled = F.when(sound & (F.coalesce(peak, F.lit(0.0)) > 0), F.transform(x, lambda v: v / peak))
    rows = table.select("vec_id", "label", scaled.alias("embedding"))
    rows = rows.withColumn("unit", F.when(F.col("embedding").isNotNull(), F.transform("embedding", lambda v: v / norm)))
    rows = written(rows.select("vec_id", "label", "unit").withColumn("entry_key", F.when(F.col("unit").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.transform("unit", lambda v: (v + 0.0).cast("string")), ",")), 256))), "vectors")
    entries = written(
        rows.where("entry_key IS NOT NULL").groupBy("entry_key").agg(F.min("vec_id").alias("first"), F.count("*").alias("rows"), F.first("label").alias("label"), F.first("unit").alias("unit")).withColumn("entry", F.xxhash64("entry_key")),
        "entries",
    )
    sizes = {r[0]: r[1] for r in entries.groupBy(F.size("unit")).count().collect()}
    per_size = []
    for width, count in sorted(sizes.items()):
        some = entries.where(F.size("unit") == width)
        shared = spark.sparkContext.broadcast(pivots(some, count))  # MOST_PIVOTS vectors at most
        described = some.select("entry", "label", "rows", "unit").mapInArrow(remote(__name__, "prefix_batches", points=shared), "entry long, label int, rows long, unit array<double>, prefix array<int>".replace("label int", f"label {table.schema['label'].dataType.simpleString()}"))
        per_size.append(described.withColumn("width", F.lit(width)))
    if not per_size:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    described = per_size[0]
    for more in per_size[1:]:
        described = described.unionByName(more)
    described = written(described, "described")
    keys = ["width", "label", "pivot"]
    lists = described.select("width", "label", F.explode("prefix").alias("pivot"), "entry")
    blocks = lists.groupBy(*keys).count().select(*keys, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    posted = described.withColumn("pivot", F.explode("prefix")).join(blocks, keys)
    own = F.pmod(F.xxhash64(F.lit("block"), "entry"), F.col("blocks")).cast("int")
    posted = posted.withColumn("own", own).withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posted = posted.withColumn("bi", F.least("own", "peer")).withColumn("bj", F.greatest("own", "peer")).withColumn("side", (F.col("own") == F.col("bj")).cast("int"))
    found = written(posted.groupBy(*keys, "bi", "bj").applyInArrow(block_function(limit), "entry long, links long, other long"), "links")
    counts = found.where("other IS NULL").groupBy("entry").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other IS NOT NULL").select(F.col("entry").alias("a"), F.col("other").alias("b")))
    named = entries.select("entry_key", "entry", "first", "rows").join(counts, "entry", "left").join(parts.withColumnRenamed("node", "entry"), "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    verdict = named.join(firsts, "component").select("entry_key", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "entry_key").join(verdict, "entry_key", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
