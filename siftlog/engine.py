"""The public interface: one object for searches, aggregations, text, SQL and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .kql.compile import compile_query
from .operators import aggregate, ordering, search, timeline
from .sources import read, write


class Engine:
    """Datasets by name, and what can be asked of them. Every answer is a DataFrame: Catalyst
    plans it, and nothing runs until it is used."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.datasets: dict[str, tuple[DataFrame, dict]] = {}

    def register(self, name: str, df: DataFrame, time_column: str | None = None, json_columns: tuple[str, ...] = (), root: str | None = None, namespaces: dict[str, list[str]] | None = None) -> None:
        """Names a dataset; it is a view for SQL as well."""
        self.datasets[name] = df, {"time": time_column, "json_columns": tuple(json_columns), "root": root, "namespaces": namespaces}
        df.createOrReplaceTempView(name)

    def drop(self, name: str) -> None:
        self.datasets.pop(name)
        self.spark.catalog.dropTempView(name)

    def list(self) -> list[str]:
        return sorted(self.datasets)

    def search(
        self,
        dataset: str | list[str],
        query: str = "*",
        *,
        columns: list[str] | None = None,
        tge: int | None = None,
        tle: int | None = None,
        ignore_case: bool = False,
        count: bool = False,
        count_by_time: int | None = None,
        min: str | None = None,
        max: str | None = None,
        unique: str | None = None,
        max_results: int | None = None,
        group_by: list[str] = (),
    ) -> DataFrame:
        """Records that match, projected; or one aggregation of them; or the newest of them.
        Several datasets are one, with rows tagged by theirs."""
        asked = [x for x in (count or None, count_by_time, min, max, unique) if x is not None]
        if len(asked) > 1:
            raise search.ArgumentError("one aggregation at most")
        if asked and columns:
            raise search.ArgumentError("an aggregation has no projection")
        names = [dataset] if isinstance(dataset, str) else list(dataset)
        parts, hows = {}, {}
        for name in names:
            df, how = self.datasets[name]
            df = search.time_filter(df, how["time"], tge, tle)
            if query.strip() != "*":
                df = df.where(compile_query(df, query, json_columns=how["json_columns"], root=how["root"], namespaces=how["namespaces"], ignore_case=ignore_case))
            parts[name], hows[name] = df, how
        json = {name: how["root"] or (how["json_columns"] or (None,))[0] for name, how in hows.items()}
        timed = count_by_time is not None or max_results is not None
        if timed and any(how["time"] is None for how in hows.values()) and (count_by_time is not None or any(how["time"] for how in hows.values())):
            raise search.ArgumentError("each dataset needs its authoritative timestamp")
        time, spare = hows[names[0]]["time"], None
        if isinstance(dataset, str):
            df = parts[dataset]
        elif (min or max or unique) is not None:
            # fields are read as each dataset has them, before the datasets are one
            field = min or max or unique
            read_as = {name: aggregate.with_parts(part, field, json[name]) for name, part in parts.items()}
            df = aggregate.union_tagged(read_as)
        else:
            if timed and time:
                (spare,) = ordering.free_names([c for part in parts.values() for c in part.columns], "authoritative_time")
                parts = {name: part.withColumn(spare, search.epoch_nanos(part, hows[name]["time"])) for name, part in parts.items()}
                time = spare
            if columns:
                kept = [*columns, *([spare] if spare else [])]
                parts = {name: search.project(part, kept, json[name]) for name, part in parts.items()}
            df = aggregate.union_tagged(parts)
        by = list(group_by)
        if count:
            return aggregate.count(df, by)
        if count_by_time is not None:
            return aggregate.count_by_time(df, time, count_by_time, by)
        own = json[names[0]]
        if min is not None:
            return aggregate.extreme(df, min, "min", own, by)
        if max is not None:
            return aggregate.extreme(df, max, "max", own, by)
        if unique is not None:
            return aggregate.unique(df, unique, own, by)
        if max_results is not None:
            df = ordering.latest(df, time, max_results) if time else df.limit(max_results)
        if spare:
            return df.drop(spare)
        return search.project(df, columns, own) if columns and isinstance(dataset, str) else df

    def observed(self, df: DataFrame, name: str = "matches") -> tuple[DataFrame, Observation]:
        """``df``, and how many rows passed once it has run."""
        seen = Observation(name)
        return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen

    def text_search(self, dataset: str, pattern: str, column: str = "message", **options) -> DataFrame:
        df, how = self.datasets[dataset]
        return search.text_search(df, pattern, column, time_column=how["time"], **options)

    def sql(self, text: str) -> DataFrame:
        """Any Spark SQL over the datasets."""
        return self.spark.sql(text)

    def guided(self, table: str, select: str, timestamp: str, begin: str, end: str, where: str | None = None, order: str | None = None, limit: int | None = None) -> DataFrame:
        """A search from fragments, each checked by itself."""
        for kind, text in (("select", select), ("where", where), ("order", order)):
            if text:
                timeline.check_fragment(self.spark, kind, text)
        return self.spark.sql(timeline.guided_search_sql(table, select, where, timestamp, begin, end, order, limit))

    def submit(self, tag: str, df: DataFrame, path: str) -> None:
        """Stores results under a tag by which ``cancel`` finds the job."""
        self.spark.addTag(tag)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.removeTag(tag)

    def cancel(self, tag: str) -> list[str]:
        return self.spark.interruptTag(tag)

    def compress(self, paths: str | list[str], target: str, timestamp_key: str | None = None, unstructured: bool = False) -> DataFrame:
        """JSON or text files as an archive; returns its catalogue row."""
        if unstructured:
            rows = read.group_events(read.read_text_lines(self.spark, paths)).withColumnRenamed("event_ix", "log_event_idx")
        else:
            rows = read.read_records(self.spark, paths, timestamp_key).where("record IS NOT NULL").withColumn("log_event_idx", F.monotonically_increasing_id())
            if not timestamp_key:
                rows = rows.withColumn("ts_ns", F.lit(None).cast("long"))
        write.write_archive(rows, target)
        return read.catalogue(self.spark.read.parquet(target), target)
