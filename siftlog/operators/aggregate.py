"""The five aggregations of a search, at most one at a time, and the reports over metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import json_field, quoted, type_tag
from .search import ArgumentError, epoch_millis

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)


def count(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """{count}; no row where nothing matched. by: e.g. the archive."""
    return df.groupBy(*by).agg(F.count("*").alias("count")).where("count > 0")


def count_by_time(df: DataFrame, column: str, size_ms: int, by: list[str] = ()) -> DataFrame:
    """{timestamp, count} of every bucket that has rows; the division cuts towards zero."""
    if size_ms <= 0:
        raise ArgumentError("a bucket has a positive size")
    bucket = df.withColumn("timestamp", epoch_millis(df, column))
    bucket = bucket.withColumn("timestamp", F.expr(f"(timestamp div {size_ms}) * {size_ms}"))
    return bucket.groupBy(*by, "timestamp").agg(F.count("*").alias("count"))


#: Holds the readings of an aggregated field where each of several datasets has its own.
READ_AS = "_siftlog_read_as"


def with_parts(df: DataFrame, name: str, json_column: str | None = None) -> DataFrame:
    """``df`` with the readings of a field in one column; all null where the dataset lacks it."""
    tokens = tuple(name.split("."))
    if tokens[0] in df.columns or json_field(df, json_column, tokens) is not None:
        parts = field_parts(df, name, json_column)
    else:
        parts = {k: F.lit(None).cast(t) for k, t in (("int", "long"), ("float", "double"), ("string", "string"), ("bool", "boolean"))}
    return df.withColumn(READ_AS, F.struct(*(c.alias(k) for k, c in parts.items())))


def field_parts(df: DataFrame, name: str, json_column: str | None = None) -> dict[str, Column]:
    """Integer, float, text and boolean readings of a field; paths do not enter arrays."""
    tokens = tuple(name.split("."))
    if not name or "*" in tokens:
        raise ArgumentError("an aggregated field has a name without wildcards")
    if READ_AS in df.columns:
        return {k: F.col(READ_AS).getField(k) for k in ("int", "float", "string", "bool")}
    null = F.lit(None)
    v = json_field(df, json_column, tokens)
    if v is not None:
        tag = type_tag(v)
        return {
            "int": F.when(tag == "BIGINT", F.try_variant_get(v, "$", "bigint")),
            "float": F.when(tag.isin("DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, "$", "double")),
            "string": F.when(tag == "STRING", F.try_variant_get(v, "$", "string")),
            "bool": F.when(tag == "BOOLEAN", F.try_variant_get(v, "$", "boolean")),
        }
    column, dtype = F.col(".".join(map(quoted, tokens))), df.select(F.col(".".join(map(quoted, tokens)))).schema[0].dataType
    return {
        "int": column.cast("long") if isinstance(dtype, INTS) else null.cast("long"),
        "float": column.cast("double") if isinstance(dtype, FLOATS) else null.cast("double"),
        "string": column if isinstance(dtype, T.StringType) else null.cast("string"),
        "bool": column if isinstance(dtype, T.BooleanType) else null.cast("boolean"),
    }


def extreme(df: DataFrame, name: str, kind: str, json_column: str | None = None, by: list[str] = ()) -> DataFrame:
    """{field, min} or {field, max} over the numbers of a field, integers and floats compared
    exactly: ``int_value`` or ``float_value`` has the winner, ``value`` its double. Nothing
    comes of a field without numbers."""
    pick = {"min": F.min, "max": F.max}[kind]
    parts = field_parts(df, name, json_column)
    # a NaN is no number to compare
    sides = df.select(*by, parts["int"].alias("i"), F.when(~F.isnan(parts["float"]), parts["float"]).alias("f"))
    best = sides.groupBy(*by).agg(pick("i").alias("i"), pick("f").alias("f")).where("i IS NOT NULL OR f IS NOT NULL")
    # longs fit decimal(38,15); doubles beyond them need no exactness
    far = F.abs(F.col("f")) >= 9.3e18
    exact = F.when(far, F.signum("f")).otherwise(F.signum(F.col("f").cast("decimal(38,15)") - F.col("i").cast("decimal(38,15)")))
    float_wins = F.when(F.col("i").isNull(), True).when(F.col("f").isNull(), False).otherwise(exact < 0 if kind == "min" else exact > 0)
    return best.select(
        *by,
        F.lit(name).alias("field"),
        F.when(~float_wins, F.col("i")).alias("int_value"),
        F.when(float_wins, F.col("f")).alias("float_value"),
        F.when(float_wins, F.col("f")).otherwise(F.col("i").cast("double")).alias(kind),
    )


def unique(df: DataFrame, name: str, json_column: str | None = None, by: list[str] = ()) -> DataFrame:
    """{field, type, value} of every distinct scalar: 1 and 1.0 differ. ``type_rank`` orders
    integers before floats, texts and booleans."""
    parts = field_parts(df, name, json_column)
    tagged = df.select(*by, *(c.alias(k) for k, c in parts.items())).distinct()
    kinds = ["int", "float", "string", "bool"]
    rank = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(n)) for n, k in enumerate(kinds)])
    value = F.coalesce(*[F.col(k).cast("string") for k in kinds])
    kind = F.element_at(F.array(*map(F.lit, kinds)), rank + 1)
    return tagged.where(rank.isNotNull()).select(*by, F.lit(name).alias("field"), rank.alias("type_rank"), kind.alias("type"), value.alias("value"))


def unique_ordered(found: DataFrame) -> DataFrame:
    number = F.when(F.col("type_rank") < 2, F.col("value").cast("double"))
    return found.orderBy("type_rank", number, "value")


def dataset_details(files: dict[str, DataFrame], archives: dict[str, DataFrame]) -> DataFrame:
    """First and last timestamp over all archives, distinct files and messages over all datasets."""
    spans = union_tagged(archives).agg(F.min("begin_timestamp").alias("begin_timestamp"), F.max("end_timestamp").alias("end_timestamp"))
    counts = union_tagged(files).agg(F.countDistinct("orig_file_id").alias("num_files"), F.coalesce(F.sum("num_messages"), F.lit(0)).alias("num_messages"))
    # a row each
    return spans.withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one").drop("_one")


def space_savings(archives: dict[str, DataFrame]) -> DataFrame:
    """Total sizes and the share that compression saves."""
    sums = union_tagged(archives).agg(F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("uncompressed_size"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    return sums.withColumn("savings", F.when(F.col("uncompressed_size") > 0, 1 - F.col("size") / F.col("uncompressed_size")))


def time_range(archives: dict[str, DataFrame]) -> DataFrame:
    return union_tagged(archives).agg(F.min("begin_timestamp").alias("begin_timestamp"), F.max("end_timestamp").alias("end_timestamp"))


def union_tagged(datasets: dict[str, DataFrame]) -> DataFrame:
    """All datasets as one, rows tagged with theirs; columns a dataset lacks are null."""
    if not datasets:
        raise ArgumentError("no dataset")
    out = None
    for name, df in datasets.items():
        tagged = df.withColumn("dataset", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def compression_usage(jobs: DataFrame, tasks: DataFrame, begin: Column, end: Column, statuses: list[str], limit: int) -> DataFrame:
    """A row a job that has tasks, started in [begin, end) with one of the statuses: its sizes and
    the sum of its tasks' durations, newest first."""
    chosen = jobs.where((F.col("start_time") >= begin) & (F.col("start_time") < end) & F.col("status").isin(statuses))
    spent = tasks.groupBy("job_id").agg(F.sum("duration").alias("duration"))
    joined = chosen.join(spent, chosen["id"] == spent["job_id"]).drop("job_id")
    return joined.orderBy(F.desc("start_time"), "id").limit(limit)
