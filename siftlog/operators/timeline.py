"""Timelines: guided SQL over a table, and how wide their buckets should be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DURATIONS_MS = [
    *(s * 1000 for s in (1, 2, 5, 10, 15, 30)),
    *(m * 60_000 for m in (1, 2, 5, 10, 15, 20, 30)),
    *(h * 3_600_000 for h in (1, 2, 3, 4, 6, 8, 12)),
    *(d * 86_400_000 for d in (1, 2, 7, 15, 30, 60, 90, 180, 365)),
]


def bucket_size(begin_ms: int, end_ms: int, points: int) -> int:
    """The least duration of the list that covers the range with so many points."""
    want = (end_ms - begin_ms) / max(points, 1)
    return next((d for d in DURATIONS_MS if d >= want), -(-int(want) // DURATIONS_MS[-1]) * DURATIONS_MS[-1])


def expanded(begin_ms: int, end_ms: int, size_ms: int) -> tuple[int, int]:
    """The range with its ends at multiples of the size."""
    return begin_ms // size_ms * size_ms, -(-end_ms // size_ms) * size_ms


def guided_timeline(df: DataFrame, column: str, begin: float, end: float, buckets: int) -> DataFrame:
    """{idx, timestamp, count} of equal buckets of [begin, end) in epoch seconds, empty ones too."""
    seconds = F.unix_micros(F.col(column).cast("timestamp")) / 1e6
    counted = df.where((seconds >= begin) & (seconds < end)).groupBy(F.width_bucket(seconds, F.lit(float(begin)), F.lit(float(end)), F.lit(buckets)).alias("idx")).agg(F.count("*").alias("count"))
    # as many rows as the chart has points
    frame = df.sparkSession.range(1, buckets + 1).select(F.col("id").alias("idx"))
    width = (end - begin) / buckets
    joined = frame.join(counted, "idx", "left")
    return joined.select("idx", (F.lit(float(begin)) + (F.col("idx") - 1) * F.lit(width)).alias("timestamp"), F.coalesce("count", F.lit(0)).alias("count"))


def guided_search_sql(table: str, select: str, where: str | None, timestamp: str, begin: str, end: str, order: str | None = None, limit: int | None = None) -> str:
    """The text of a guided search: fragments in fixed places."""
    text = f"SELECT {select} FROM {table} WHERE {timestamp} BETWEEN {begin} AND {end}"
    if where:
        text += f" AND ({where})"
    if order:
        text += f" ORDER BY {order}"
    if limit is not None:
        text += f" LIMIT {int(limit)}"
    return text


class FragmentError(ValueError):
    """A fragment that is not one select list, condition or sort list."""


def check_fragment(spark, kind: str, text: str) -> None:
    """Whether a fragment alone parses in its place; nothing of it is run."""
    query = {"select": f"SELECT {text} FROM t", "where": f"SELECT 1 FROM t WHERE ({text})", "order": f"SELECT 1 FROM t ORDER BY {text}"}[kind]
    if ";" in text:
        raise FragmentError("a fragment is no statement")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query).toString()
    except Exception as error:
        raise FragmentError(str(error).splitlines()[0]) from None
    if "With" in plan.split("\n")[0] or "Union" in plan:
        raise FragmentError("a fragment is no query")
