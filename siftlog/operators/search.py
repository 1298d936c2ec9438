"""Filters beside the query language: time ranges, files, text patterns; and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import wildcard
from ..functions.timestamps import timestamp_ns
from ..kql.parser import path_of
from ..plans.catalog import json_field, quoted, variant_at

TIME_TYPES = (T.TimestampType, T.TimestampNTZType)


class ArgumentError(ValueError):
    """Options that make no sense together."""


def millis(value: int, dtype: T.DataType) -> Column:
    """Epoch milliseconds as a literal of the column's type, so that the filter reaches the reader."""
    if isinstance(dtype, TIME_TYPES):
        return F.timestamp_micros(F.lit(value * 1000)).cast(dtype)
    return F.lit(value * 10**6).cast("long")


def time_filter(df: DataFrame, column: str | None, tge: int | None = None, tle: int | None = None, tgt: int | None = None, tlt: int | None = None, teq: int | None = None) -> DataFrame:
    """Rows within bounds in epoch milliseconds on the authoritative timestamp, a timestamp column
    or one of nanoseconds. Strict bounds move by a millisecond; ``teq`` excludes the rest."""
    given = [x for x in (tge, tle, tgt, tlt) if x is not None]
    if teq is not None:
        if given:
            raise ArgumentError("teq stands alone")
        tge = tle = teq
    if tge is not None and tgt is not None or tle is not None and tlt is not None:
        raise ArgumentError("one lower and one upper bound at most")
    low = tgt + 1 if tgt is not None else tge
    high = tlt - 1 if tlt is not None else tle
    if low is None and high is None:
        return df
    if column is None or column not in df.columns:
        raise ArgumentError("a time range needs the authoritative timestamp column")
    if low is not None and high is not None and low > high:
        raise ArgumentError("the range ends before it begins")
    dtype = df.schema[column].dataType
    if low is not None:
        df = df.where(F.col(quoted(column)) >= millis(low, dtype))
    if high is not None:
        df = df.where(F.col(quoted(column)) <= millis(high, dtype))
    return df


def epoch_millis(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds of the authoritative timestamp, cut towards zero."""
    c = F.col(quoted(column))
    if isinstance(df.schema[column].dataType, TIME_TYPES):
        return F.expr(f"unix_micros(CAST({quoted(column)} AS TIMESTAMP)) div 1000")
    return F.expr(f"{quoted(column)} div 1000000")


def text_search(df: DataFrame, pattern: str, column: str = "message", ignore_case: bool = False, file_path: str | None = None, time_column: str | None = None, **times) -> DataFrame:
    """Rows whose text has the wildcard pattern anywhere in it."""
    df = time_filter(df, time_column, **times)
    if file_path is not None:
        df = df.where(F.col("orig_file_path") == file_path)
    return df.where(wildcard.contains(F.col(quoted(column)), pattern, ignore_case))


def text_search_any(df: DataFrame, patterns: list[str], column: str = "message", ignore_case: bool = False) -> DataFrame:
    """Rows that have any of several patterns; one scan for all of them."""
    test = F.lit(False)
    for p in patterns:
        test = test | wildcard.contains(F.col(quoted(column)), p, ignore_case)
    return df.where(test)


def search_by_template(df: DataFrame, pattern: str, column: str = "message", logtype: str = "logtype") -> DataFrame:
    """Text search over rows stored with their template. Literal runs of the pattern that hold no
    token that could be a variable must stand in the template, a short column that is read
    first; the wildcard match itself decides."""
    import re

    runs = [r for r in re.split(r"[*?]", wildcard.clean(pattern).replace("\\", "\0")) if "\0" not in r]
    df_out = df
    for run in runs:
        # whole words alone: at the edges a run may be part of a longer token
        for word in re.findall(r"(?<=[^+\-.0-9A-Z\\_a-z=])[A-Za-z]+(?=[^+\-.0-9A-Z\\_a-z])", run):
            if not re.fullmatch(r"[0-9a-fA-F]{2,}", word):
                df_out = df_out.where(F.col(logtype).contains(word))
    return df_out.where(wildcard.contains(F.col(quoted(column)), pattern))


def epoch_nanos(df: DataFrame, column: str) -> Column:
    """Epoch nanoseconds of the authoritative timestamp: one scale for datasets of any kind."""
    c = F.col(quoted(column))
    if isinstance(df.schema[column].dataType, TIME_TYPES):
        return F.expr(f"unix_micros(CAST({quoted(column)} AS TIMESTAMP)) * 1000")
    return c.cast("long")


def project(df: DataFrame, columns: list[str], json_column: str | None = None, allow_duplicates: bool = False) -> DataFrame:
    """Chosen fields, by dotted paths without wildcards; of a JSON column as variants. Each is
    named by its path."""
    out, seen = [], set()
    for name in columns:
        path = path_of(name)
        if path.wild:
            raise ArgumentError(f"{name!r} has a wildcard")
        if path.tokens in seen and not allow_duplicates:
            raise ArgumentError(f"{name!r} is projected twice")
        seen.add(path.tokens)
        field = json_field(df, json_column, path.tokens) if len(path.tokens) > 1 or path.tokens[0] not in df.columns else None
        if field is not None:
            out.append(field.alias(name))
            continue
        dtype: T.DataType = df.schema
        column = None
        for token in path.tokens:
            if not isinstance(dtype, T.StructType) or token not in dtype.names:
                raise ArgumentError(f"{name!r} is no column")
            dtype, column = dtype[token].dataType, F.col(quoted(token)) if column is None else column.getField(token)
        if isinstance(dtype, T.StructType):
            raise ArgumentError(f"{name!r} is an object")
        out.append(column.alias(name))
    return df.select(*out)


def project_json(df: DataFrame, columns: list[str], json_column: str, keep: list[str] = ()) -> DataFrame:
    """Records cut down to chosen fields and written as JSON again; fields a record lacks are
    left out, nesting is kept."""
    tree: dict = {}
    for name in columns:
        node = tree
        *parents, last = path_of(name).tokens
        for t in parents:
            node = node.setdefault(t, {})
        node[last] = path_of(name).tokens

    def build(node: dict) -> Column:
        fields = []
        for key, value in node.items():
            inner = build(value) if isinstance(value, dict) else F.to_json(variant_at(F.col(quoted(json_column)), value))
            name = F.to_json(F.struct(F.lit(key).alias("k")))
            label = F.regexp_extract(name, r'^\{"k":(.*)\}$', 1)
            fields.append(F.when(inner.isNotNull() & (inner != "{}") if isinstance(value, dict) else inner.isNotNull(), F.concat(label, F.lit(":"), inner)))
        return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}"))

    return df.select(*keep, build(tree).alias("message"))


def serialize(df: DataFrame, json_column: str | None = None) -> DataFrame:
    """Each record as one line of JSON."""
    if json_column:
        return df.select(F.to_json(F.col(quoted(json_column))).alias("message"))
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("message"))
