"""What other SQL dialects say and Spark's does not: quantified comparison, GROUPS frames,
NORMALIZE, and functions under other names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalize(column: Column, form: str = "NFC") -> Column:
    """Unicode normal form. Text of ASCII alone, which every form leaves as it is, stays in the JVM."""

    @F.pandas_udf("string")
    def one(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    plain = ~column.rlike(r"[^\x00-\x7f]")
    return F.when(plain, column).otherwise(one(F.when(~plain, column)))


def quantified(df: DataFrame, column: str, op: str, how: str, values: DataFrame) -> DataFrame:
    """Rows for which ``column op ALL (values)`` or ``ANY``: by the extreme of the values, one row
    that joins. Over no values ALL holds and ANY does not; a null among them leaves ALL unknown."""
    x = values.columns[0]
    facts = values.agg(F.min(x).alias("_low"), F.max(x).alias("_high"), F.count("*").alias("_n"), F.count(x).alias("_known")).first()
    low, high, n, known = facts
    c = F.col(column)
    tests = {"<": (c < low, c < high), "<=": (c <= low, c <= high), ">": (c > high, c > low), ">=": (c >= high, c >= low)}
    if how == "ALL":
        if n == 0:
            return df
        return df.where(tests[op][0]) if n == known else df.where(F.lit(False))
    return df.where(tests[op][1]) if known else df.where(F.lit(False))


def groups_sum(df: DataFrame, columns: list[str], key: Column, value: Column, before: int, after: int, name: str, few: bool = False) -> DataFrame:
    """``columns``, and as ``name`` sum(value) OVER (ORDER BY key NULLS LAST GROUPS BETWEEN before PRECEDING AND after FOLLOWING).

    Rows of one key have one frame. So rows are summed up by key where they lie, the window is over one row
    a key, in one task, and its sums go back by a join. few: the keys are so few that their sums may be broadcast.
    """
    rows = df.select(*columns, key.alias("_key"), value.alias("_value"))
    sums = rows.groupBy(F.col("_key").alias("_of")).agg(F.sum("_value").alias("_sum"))
    frame = Window.orderBy(F.asc_nulls_last("_of")).rowsBetween(-before, after)
    framed = sums.select("_of", F.sum("_sum").over(frame).alias(name))
    return rows.join(F.broadcast(framed) if few else framed, F.col("_key").eqNullSafe(F.col("_of"))).select(*columns, name)


def from_unixtime(column: Column) -> Column:
    """Timestamp of epoch seconds with a fraction."""
    return F.timestamp_micros(F.round(column.cast("double") * 1_000_000).cast("long"))


def to_unixtime(column: Column) -> Column:
    """Epoch seconds of a timestamp, with the fraction."""
    return F.unix_micros(column.cast("timestamp")) / 1e6
