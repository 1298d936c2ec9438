"""Operator 8: near-duplicates by SimHash, found by a self-join of the fingerprints' binary trie.

Fingerprints are made in one pass over the texts and collapsed to distinct ones. The trie
is cut at a depth where subtries are small; every pair of subtries whose paths differ in no
more bits than the budget is one task's work, so that no fingerprint is compared by key
equality and none is missed. Inside, pairs of nodes go down the trie together, add up the
bits in which their paths differ, and are dropped as soon as they exceed the budget. A
pair of subtries gives a spanning forest of its links, never all of them.

Defined cases: null and wordless texts have fingerprint zero and link like any other;
rows with a null id get a fingerprint and the component of its least non-null id (null if
there is none); repeated rows come as often as they are given; texts of any length are
hashed whole, in blocks; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, connected_components, hot_key_join, remote, texts_of, written

BITS = 64
SEED = 42
WORDS = 3
BUDGET = 2
#: Fingerprints that a subtrie should hold on average: 128 kB a cell, and few copies of each fingerprint.
SUBTRIE = 1 << 14
#: Node pairs that are expanded at once; more wait their turn.
FRONTIER = 1 << 18


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, count: int) -> int:
    """The bits set in over half of ``count`` hashes, of which ``ones`` have each."""
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprint(text: str, words: int = WORDS, block: int = 1 << 15) -> int:
    """SimHash of the word shingles, each as often as it occurs; bytes.lower folds A-Z alone
    and bytes.split cuts at ASCII white space alone."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(found) <= words:
        return digest(join(found), SEED)
    count = len(found) - words + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, block):
        part = found[at : at + block + words - 1]
        grams = zip(*(part[k:] for k in range(words)))
        ones += bit_counts(np.array([digest(join(g), SEED) for g in grams], np.uint64))
    return majority(ones, count)


def fingerprint_batches(batches, words: int):
    for batch in batches:
        prints = np.array([fingerprint(t, words) for t in texts_of(batch.column("text"))], np.uint64).view(np.int64)
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(prints)], [*rest, "fp"])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with fp, the fingerprint as a signed long, in place of the text."""
    bound_batches(docs.sparkSession)
    schema = T.StructType([*(f for f in docs.schema if f.name != "text"), T.StructField("fp", T.LongType())])
    return docs.mapInArrow(remote(__name__, "fingerprint_batches", words=words), schema)


def trie_pairs(a: np.ndarray, b: np.ndarray, depth: int, budget: int, same: bool):
    """Index pairs of sorted distinct fingerprints (``same``: of one array, i < j) within
    ``budget`` bits. Both lie in one subtrie each, cut at ``depth``.

    A node is a range of the array; a bit's prefix counts of zeros cut it in two. Pairs of
    single leaves are settled by their difference at once, which is what walking on would
    give.
    """
    if not len(a) or not len(b):
        return
    zeros: dict = {}

    def split(side: int, level: int) -> np.ndarray:
        if (side, level) not in zeros:
            x = a if side == 0 or same else b
            zeros[side, level] = np.concatenate([[0], np.cumsum((x >> np.uint64(BITS - 1 - level)) & np.uint64(1) == 0)])
        return zeros[side, level]

    spent = int(a[0] ^ b[0]) >> (BITS - depth) if depth else 0
    stack = [(depth, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), budget - spent.bit_count())))]
    while stack:
        level, a0, a1, b0, b1, left = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(level, *(x[:half] for x in (a0, a1, b0, b1, left))), (level, *(x[half:] for x in (a0, a1, b0, b1, left)))]
            continue
        done = (a1 - a0 == 1) & (b1 - b0 == 1)
        if done.any():
            i, j = a0[done], b0[done]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
            a0, a1, b0, b1, left = (x[~done] for x in (a0, a1, b0, b1, left))
        if not len(a0):
            continue
        za, zb = split(0, level), split(1, level)
        am, bm = a0 + za[a1] - za[a0], b0 + zb[b1] - zb[b0]
        nxt = []
        for x0, x1, y0, y1, cost in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            ok = (x0 < x1) & (y0 < y1) & (left >= cost)
            if same:  # the mirrored pair finds the same
                ok &= x0 <= y0
                ok &= ~((x0 == y0) & (x1 - x0 == 1) & (y1 - y0 == 1))
            nxt.append((x0[ok], x1[ok], y0[ok], y1[ok], left[ok] - cost))
        joined = tuple(np.concatenate(x) for x in zip(*nxt))
        if len(joined[0]):
            stack.append((level + 1, *joined))


def forest(pairs, n: int) -> list[tuple[int, int]]:
    """Edges that span what ``pairs`` connect."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in pairs:
        p, q = root(i), root(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def cell_links(key, table: pa.Table, depth: int, budget: int) -> pa.Table:
    """Spanning links of one pair of subtries. table: cell, side, fp."""
    fp = table.column("fp").to_numpy().view(np.uint64)
    side = table.column("side").to_numpy()
    a, b = np.unique(fp[side == 0]), np.unique(fp[side == 1])
    low, high = [], []
    same = not len(b) and bool(table.column("diagonal")[0].as_py())
    if same:
        both, shift = a, 0
        found = trie_pairs(a, a, depth, budget, True)
    else:
        both, shift = np.concatenate([a, b]), len(a)
        found = trie_pairs(a, b, depth, budget, False)
    parent = np.arange(len(both))
    for i, j in found:
        for p, q in forest(zip(i.tolist(), (j + shift).tolist()), len(parent)) if len(i) else ():
            low.append(p)
            high.append(q)
    edges = forest(zip(low, high), len(both))
    ends = both.view(np.int64)
    return pa.table({"a": pa.array([int(ends[p]) for p, _ in edges], pa.int64()), "b": pa.array([int(ends[q]) for _, q in edges], pa.int64())})


def cell_function(depth: int, budget: int):
    module, root = __name__, __import__("siftlog.llm.common", fromlist=["_ROOT"])._ROOT

    def run(key, table):
        import importlib
        import sys

        try:
            found = importlib.import_module(module)
        except ModuleNotFoundError as error:
            if not module.startswith(error.name or "?"):
                raise
            sys.path.insert(0, root)
            found = importlib.import_module(module)
        return found.cell_links(key, table, depth, budget)

    return run


def near_paths(depth: int, budget: int) -> list[int]:
    """Masks of at most ``budget`` bits among the first ``depth``."""
    masks = [0]
    for _ in range(budget):
        masks = sorted({m ^ (1 << k) for m in masks for k in range(depth)} | set(masks))
    return masks


def links(prints: DataFrame, distinct: int, budget: int = BUDGET) -> DataFrame:
    """Spanning links (a, b) between the distinct fingerprints ``fp`` of ``prints``.

    The depth of the cut follows their number, so the subtries stay small and a
    fingerprint goes to as many cells as there are paths within the budget.
    """
    depth = max(0, min(24, (max(distinct, 1) // SUBTRIE).bit_length()))
    path = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    masks = F.array(*[F.lit(m).cast("long") for m in near_paths(depth, budget)])
    cells = (
        prints.select("fp", path.alias("path"))
        .withColumn("other", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("path")))))
        .select(
            F.least("path", "other").alias("p"),
            F.greatest("path", "other").alias("q"),
            (F.col("path") > F.col("other")).cast("int").alias("side"),
            (F.col("path") == F.col("other")).alias("diagonal"),
            "fp",
        )
    )
    return cells.groupBy("p", "q").applyInArrow(cell_function(depth, budget), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = written(fingerprints(docs.select("doc_id", "text"), words), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "classes")
    sizes = classes.agg(F.count("*"), F.sum("rows")).first()
    joined = connected_components(links(classes.select("fp"), sizes[0], budget))
    named = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    table = named.join(firsts, "component").select("fp", "component_id", F.col("rows").alias("_rows"))
    return hot_key_join(prints, table, "fp", F.col("_rows"), sizes[1] or 0).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
