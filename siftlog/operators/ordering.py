"""Latest results, sorting, pages, and archives in the order in which to read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.catalog import quoted
from .search import ArgumentError

DEFAULT_RESULTS = 1000


def free_names(names: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, with underscores before them where they would clash with ``names``."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def latest(df: DataFrame, column: str, k: int = DEFAULT_RESULTS, tie: list[str] = ()) -> DataFrame:
    """The k newest rows; each task keeps k of its own and nothing is sorted whole."""
    if k <= 0:
        raise ArgumentError("the number of results is positive")
    return df.orderBy(F.desc_nulls_last(column), *tie).limit(k)


def latest_by_archive(df: DataFrame, column: str, k: int, tie: list[str], archive: str = "archive_id") -> DataFrame:
    """The k newest rows of each archive."""
    place = F.row_number().over(Window.partitionBy(archive).orderBy(F.desc_nulls_last(column), *tie))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def limit_results(df: DataFrame, n: int, default: int = DEFAULT_RESULTS) -> DataFrame:
    """At most n rows; 0 stands for the default."""
    return df.limit(n or default)


def sorted_results(df: DataFrame, column: str = "timestamp", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), tie)


def page(df: DataFrame, number: int, size: int, column: str = "timestamp", tie: str = "id") -> DataFrame:
    """The number-th page, from 1, of the sorted results."""
    if number < 1 or size < 1:
        raise ArgumentError("pages and their sizes begin at 1")
    return sorted_results(df, column, tie).offset((number - 1) * size).limit(size)


def archives_for(archives: DataFrame, begin_ms: int | None, end_ms: int | None, retain_from_ms: int | None = None) -> DataFrame:
    """Archives that overlap a time range and are not past retention, newest end first. An end
    of 0 means that an archive has no timestamps; retention leaves it."""
    if begin_ms is not None:
        archives = archives.where(F.col("end_timestamp") >= begin_ms)
    if end_ms is not None:
        archives = archives.where(F.col("begin_timestamp") <= end_ms)
    if retain_from_ms is not None:
        archives = retained(archives, retain_from_ms)
    return archives.orderBy(F.desc("end_timestamp"), "id")


def retained(archives: DataFrame, from_ms: int) -> DataFrame:
    return archives.where((F.col("end_timestamp") >= from_ms) | (F.col("end_timestamp") == 0))


def expired(archives: DataFrame, before_ms: int) -> DataFrame:
    return archives.where((F.col("end_timestamp") < before_ms) & (F.col("end_timestamp") != 0))


def latest_with_stop(archives: list[tuple[object, int, int]], read, column: str, k: int, tie: list[str], batch: int = 8) -> DataFrame:
    """The k newest rows over archives (key, begin, end), newest end first, a batch at a time;
    it stops as soon as k rows are all newer than whatever the rest could hold.

    read: keys -> DataFrame. The archives are a catalogue's rows, not data; what is kept
    between batches is k rows.
    """
    order = sorted(archives, key=lambda a: -a[2])
    best: DataFrame | None = None
    rows = None
    for at in range(0, len(order), batch):
        part = latest(read([a[0] for a in order[at : at + batch]]), column, k, tie)
        best = part if rows is None else latest(part.sparkSession.createDataFrame(rows, part.schema).union(part), column, k, tie)
        rows = best.collect()
        best = best.sparkSession.createDataFrame(rows, best.schema)
        left = order[at + batch :]
        if left and len(rows) >= k and rows[-1][column] is not None and rows[-1][column] > max(a[2] for a in left):
            break
    if best is None:
        raise ArgumentError("no archive")
    return best


def range_of(df: DataFrame, order: str, parts: int, each: int = 100) -> Column:
    """The number of the range that a row's ``order`` falls into, from 0; nulls are in the first.

    The bounds come from a sample of about ``each`` values a range and become part of the
    expression, so whatever is computed from it, in whichever plan, agrees. Any bounds give
    right results; the sample only evens the ranges out.
    """
    rows = df.count()
    share = min(1.0, parts * each / max(1, rows))
    values = df.select(order).where(F.col(quoted(order)).isNotNull())
    drawn = [r[0] for r in (values.sample(share, 7) if share < 1 else values).orderBy(order).collect()]
    bounds = sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []

    def below(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(quoted(order)) < F.lit(bounds[mid]), below(low, mid)).otherwise(below(mid + 1, high))

    return F.when(F.col(quoted(order)).isNull(), 0).otherwise(below(0, len(bounds)))


def chunked(df: DataFrame, order: str, size: Column, target: int) -> DataFrame:
    """Rows in log order with the chunk each falls into; a chunk ends with the row that brings it
    to the target size.

    Sizes are summed by range first, so no task holds more than a range: each range knows its
    total, and only totals meet in one place. Rows of equal ``order`` share a range.
    """
    part, own, before, total = free_names(df.columns, "part", "size", "before", "total")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn(own, size.cast("long")).withColumn(part, range_of(df, order, parts))
    totals = ranged.groupBy(part).agg(F.sum(own).alias(total))
    # a row a range
    sums = totals.select(part, F.coalesce(F.sum(total).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    placed = ranged.join(F.broadcast(sums), part)
    running = F.col(before) + F.coalesce(F.sum(own).over(Window.partitionBy(part).orderBy(quoted(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("chunk", F.floor(running / target).cast("long")).drop(own, part, before)


def chunk_index(df: DataFrame, order: str) -> DataFrame:
    """{chunk, begin_ix, end_ix, is_last_chunk} of every chunk. ``end_ix`` is exclusive: where the next
    chunk begins, and in the last chunk one past its last row."""
    begins = df.groupBy("chunk").agg(F.min(order).alias("begin_ix"), F.max(order).alias("last_ix"))
    # the chunk after, by number: chunks without rows in between are passed over by their part alone
    following = begins.select((F.col("chunk") - 1).alias("chunk"), F.col("begin_ix").alias("next_ix"))
    newest = df.agg(F.max("chunk").alias("newest"))
    spans = begins.join(following, "chunk", "left").crossJoin(F.broadcast(newest))  # one row
    return spans.select("chunk", "begin_ix", F.coalesce("next_ix", F.col("last_ix") + 1).alias("end_ix"), (F.col("chunk") == F.col("newest")).alias("is_last_chunk"))
