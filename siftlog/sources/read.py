"""Reading records: JSON lines, paired records, text logs, archives, catalogues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.timestamps import epoch_to_ns, parse_column, parse_prefix, timestamp_ns
from ..plans.catalog import type_tag

JSON, PAIRS, TEXT, EMPTY, ARCHIVE, ZSTD, GZIP, UNKNOWN = "json", "pairs", "text", "empty", "archive", "zstd", "gzip", "unknown"


def sniff(head: bytes) -> str:
    """Kind of a file by its first bytes."""
    if not head:
        return EMPTY
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return ZSTD
    if head[:2] == b"\x1f\x8b":
        return GZIP
    if head[:4] == b"PAR1":
        return ARCHIVE
    stripped = head.lstrip(b" \t\r\n\xef\xbb\xbf")
    if stripped[:1] == b"{":
        first = stripped.split(b"\n", 1)[0]
        return PAIRS if b'"auto"' in first and b'"user"' in first else JSON
    if b"\0" in head:
        return UNKNOWN
    try:
        head[:-3].decode() if len(head) > 3 else head.decode()
    except UnicodeDecodeError:
        return UNKNOWN
    return TEXT


def sniff_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, kind) of each file, read where the files are; only heads reach the function."""
    kind = F.udf(lambda b: sniff(bytes(b)), "string")  # a row a file
    return spark.read.format("binaryFile").load(paths).select("path", kind(F.substring("content", 1, 4096)).alias("kind"))


def file_path(remove_prefix: str | None = None, remove_leading_slash: bool = False) -> Column:
    """Original path of a row's file, shortened as asked."""
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    if remove_prefix:
        at = F.lit(remove_prefix.rstrip("/"))
        path = F.when(path.startswith(at), path.substr(F.lit(len(remove_prefix.rstrip("/")) + 1), F.length(path))).otherwise(path)
    if remove_leading_slash:
        path = F.regexp_replace(path, "^/+", "")
    return path


def read_records(spark: SparkSession, paths: str | list[str], timestamp_key: str | None = None, remove_prefix: str | None = None, files_from: str | None = None) -> DataFrame:
    """(record variant, rejected text, ts_ns, orig_file_path) of JSON lines.

    A line that is no JSON object, the cut-off tail of a stream among them, is kept as
    ``rejected`` and never ends the read. Records under one key of unlike types stay as they
    are: nothing is widened.
    """
    if files_from:
        paths = [r["value"].strip() for r in spark.read.text(files_from).collect() if r["value"].strip()]
    lines = spark.read.text(paths).select("value", file_path(remove_prefix).alias("orig_file_path")).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    rows = lines.withColumn("record", parsed)
    sound = F.col("record").isNotNull() & (type_tag(F.col("record")) == "OBJECT")
    out = rows.select(F.when(sound, F.col("record")).alias("record"), F.when(~F.coalesce(sound, F.lit(False)), F.col("value")).alias("rejected"), "orig_file_path")
    if timestamp_key:
        key = F.try_variant_get("record", "$." + timestamp_key, "string")
        number = F.try_variant_get("record", "$." + timestamp_key, "bigint")
        out = out.withColumn("ts_ns", F.when(key.rlike(r"^-?\d+$"), epoch_to_ns(number)).otherwise(parse_column(key)))
    return out


def read_typed(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines of a known schema, with the corrupt ones in ``_corrupt``."""
    return spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(paths)


def read_pairs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of two trees, written as JSON lines ``{"auto": {..}, "user": {..}}``: the
    auto-generated pairs and the user's, each a variant."""
    rows = read_records(spark, paths)
    return rows.where("record IS NOT NULL").select(F.try_variant_get("record", "$.auto", "variant").alias("auto"), F.try_variant_get("record", "$.user", "variant").alias("user"), "orig_file_path")


def read_text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(orig_file_path, line_no, line) in file order. A file is read whole, so that its lines keep
    their order; files are the unit of work, and large ones should be split before."""
    whole = spark.read.text(paths, wholetext=True).select(file_path().alias("orig_file_path"), F.regexp_replace("value", "\n$", "").alias("text"))
    return whole.select("orig_file_path", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


#: A date at the start of a line, as most logs have it; what else parses is asked of Python.
_TIME = ":".join([r"\d\d"] * 3)
ISO_START = r"^[\[<]{0,4}\d{4}[-/]\d\d[-/]\d\d[T ]" + _TIME
OTHER_START = r"^(\[?\d{8}-" + _TIME + r"|\d{6}[T ][ \d]\d:|\[?\d\d[-/ ]([A-Z][a-z]{2}|\d\d)[-/ ]|[A-Z][a-z]{2,8},? [\dA-Z ]|\d\d[- ]\d\d \d\d:)"


def group_events(lines: DataFrame) -> DataFrame:
    """(orig_file_path, event_ix, ts_ns, message): a line that starts with a timestamp starts an
    event and lines without one go on with it; those before the first are an event without one.

    Windows run within a file, which is what has an order.
    """
    @F.pandas_udf("long")
    def start_ns(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or (f := parse_prefix(t)) is None else f[0] for t in texts], dtype="Int64")

    maybe = F.col("line").rlike(ISO_START) | F.col("line").rlike(OTHER_START)
    stamped = lines.withColumn("_ns", start_ns(F.when(maybe, F.substring("line", 1, 64))))
    order = Window.partitionBy("orig_file_path").orderBy("line_no")
    numbered = stamped.withColumn("event_ix", F.sum(F.col("_ns").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = numbered.groupBy("orig_file_path", "event_ix").agg(F.max("_ns").alias("ts_ns"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    return grouped.select("orig_file_path", "event_ix", "ts_ns", F.array_join(F.col("_lines.line"), "\n").alias("message"))


def text_to_records(events: DataFrame) -> DataFrame:
    """Events as JSON records of (timestamp, message), or (message) where there is no timestamp."""
    return events.select(F.to_json(F.struct(F.col("ts_ns").alias("timestamp"), "message"), {"ignoreNullFields": "true"}).alias("message"))


def read_archive(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """An archive's rows; of one original file, in log order, if asked."""
    df = spark.read.parquet(path)
    if file is not None:
        df = df.where(F.col("orig_file_path") == file).orderBy("log_event_idx")
    return df


def read_results(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Stored results, newest first, then by id."""
    df = spark.read.parquet(path).orderBy(F.desc_nulls_last("timestamp"), "id")
    return df if limit is None else df.limit(limit)


def catalogue(archive: DataFrame, archive_id: str, time_column: str = "ts_ns") -> DataFrame:
    """{id, begin_timestamp, end_timestamp, num_messages} of an archive, in epoch milliseconds; 0
    and 0 where it has no timestamps."""
    ms = F.expr(f"{time_column} div 1000000")
    return archive.agg(F.coalesce(F.min(ms), F.lit(0)).alias("begin_timestamp"), F.coalesce(F.max(ms), F.lit(0)).alias("end_timestamp"), F.count("*").alias("num_messages")).select(F.lit(archive_id).alias("id"), "*")


def file_catalogue(archive: DataFrame) -> DataFrame:
    """{orig_file_path, begin_message_ix, num_messages, begin_timestamp, end_timestamp} of each file."""
    ms = F.expr("ts_ns div 1000000")
    return archive.groupBy("orig_file_path").agg(F.min("log_event_idx").alias("begin_message_ix"), F.count("*").alias("num_messages"), F.min(ms).alias("begin_timestamp"), F.max(ms).alias("end_timestamp"))


def timestamps_of(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ts_ns from a timestamp column."""
    return df.withColumn("ts_ns", timestamp_ns(F.col(column)))
