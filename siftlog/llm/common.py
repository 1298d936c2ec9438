"""What the operators share: shipping code, scratch tables, hot-key joins, components."""

from __future__ import annotations

import atexit
import contextlib
import importlib
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a record batch between the JVM and Python may hold; with texts of a few
#: hundred kB at most that bounds a worker's memory to some tens of MB.
BATCH_ROWS = 512

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_scratch: list[tuple[SparkSession, str]] = []
#: Candidate rows of a few numbers each up to this many are sent to every worker; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def remote(module: str, name: str, /, **kwargs) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that runs ``module.name(batches, **kwargs)``.

    It travels by value and imports the module where it runs, so that caches in the
    module outlive a task, and a worker without the package on its path still finds
    it where the driver does.
    """
    root = _ROOT

    def run(batches):
        try:
            found = importlib.import_module(module)
        except ModuleNotFoundError as error:
            if not module.startswith(error.name or "?"):
                raise
            sys.path.insert(0, root)
            found = importlib.import_module(module)
        return getattr(found, name)(batches, **kwargs)

    return run


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Limits the rows of a record batch in this session; a lower limit stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, only where
    nothing sets it and the master is local, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="siftlog-")
    spark.conf.set("spark.checkpoint.dir", made)
    _scratch.append((spark, made))
    return made


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _scratch:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def drop_shuffles(spark: SparkSession) -> None:
    """Has the shuffle files that nothing reads any more deleted now.

    Threads that serve listeners hold the last event until they get another one, and the end
    of a query holds its plan with its shuffles: a job without tasks gives them other events.
    """
    context = spark.sparkContext
    context._jsc.emptyRDD().count()
    with contextlib.suppress(Exception):  # if they are slow, the files go a query later
        context._jsc.sc().listenerBus().waitUntilEmpty()
    context._jvm.System.gc()


def written(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and a lost executor
    costs nothing that was already computed. release: the shuffle files behind it, which
    nothing reads any more, go at once and not when the driver next collects garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    if release:
        drop_shuffles(spark)
    # the rows just written tell the schema; no footer is read for it
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and that nothing will read any more."""
    for table in tables:
        path = table.__dict__.pop("_scratch_path", None)
        if path:
            remove(table.sparkSession, path)
            _scratch.remove((table.sparkSession, path))


def free_names(names: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with as many underscores before it as keep it from clashing with
    ``names``, which Spark compares without case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def all_columns(names: list[str]) -> list[Column]:
    """Columns of any names, dots and backticks included."""
    return [F.col(quoted(n)) for n in names]


def sized(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows, which are counted, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_identity(df: DataFrame, *columns: str) -> list[Column]:
    """128 bits that tell rows of different values apart at any number of rows."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("row"), *columns)]


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(column: Column | str, folds: int) -> Column:
    """crc32 of the id as decimal text, modulo ``folds``; null ids are in fold 0."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.pmod(F.crc32(text.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null reads as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def hot_key_join(left: DataFrame, right: DataFrame, keys: str | list[str], counts: Column, total: int, share: float = 1e-3) -> DataFrame:
    """Left join on ``keys`` (unique in ``right``) where one key may hold a third of ``left``.

    ``counts`` is the column of ``right`` that says how often its key is in ``left``. Keys
    with over ``share`` of the ``total`` rows number 1/share at most, whatever the
    input's size: those few are broadcast, and only rows with other keys are shuffled.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    bar = max(1.0, total * share)
    hot = right.where(counts > F.lit(bar))
    (mark,) = free_names([*left.columns, *right.columns], "_hot_key")
    left = left.join(F.broadcast(hot.select(*keys, F.lit(True).alias(mark))), keys, "left")
    few = left.where(F.col(mark).isNotNull()).drop(mark).join(F.broadcast(hot), keys, "left")
    rest = left.where(F.col(mark).isNull()).drop(mark).join(right.where(counts <= F.lit(bar)), keys, "left")
    return few.unionByName(rest)


def connected_components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b); component is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014). The least neighbour
    is a plain aggregate that combines before it is shuffled, and it goes back by a join
    that adaptive execution may split, so a hub of any degree never has to fit a task.
    Each round is a table in the shared folder. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    current = written(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        label,
    )

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    seen = state(current)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every edge now points from the larger to the smaller end
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        nxt = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(linked.select("u", F.col("m").alias("v"))).distinct()
        last, current = current, written(nxt, label)
        forget(last)
        now = state(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Members of a bucket that meet each other within one join key; larger buckets are cut.
BUCKET_BLOCK = 2048
#: Into how many blocks a bucket or a level of it is cut at most: so often are its rows shuffled.
MOST_BLOCKS = 8
#: Buckets of more members meet level by level, where there are levels.
LEVEL_FROM = 1024


def bucket_links(posts: DataFrame, verify: Callable[[DataFrame], DataFrame], label: str, traits: DataFrame | None = None, admit: Callable[[str, str], Column] | None = None, known: DataFrame | None = None, level: Column | None = None) -> DataFrame:
    """(a, b), a < b: verified pairs that connect all that the buckets of ``posts`` (id, post) can
    connect, as a table.

    First every id meets the least one of each of its buckets; only ids of a bucket that this
    has not brought together meet each other, so a large group of copies costs about its
    size, and no link is lost. What is left of a large bucket is cut into blocks, and each pair of blocks is a join key
    of its own, so that a hot bucket is spread over tasks and still compared whole. A row is shuffled once for each block of
    the other side. Blocks are as many as the root of the rows that meet over BUCKET_BLOCK, and MOST_BLOCKS at most: what is
    shuffled stays in proportion to the bucket, however large that is.

    admit(l, r): a condition on the columns of ``traits`` (id, ..) at either end of a pair,
    which spares ``verify`` the pairs that can't pass.

    known: verified pairs (a, b) found elsewhere, which count among the links; ids that they
    connect are not brought together again.

    level: a whole number made of ``traits``, in which no pair that admit lets pass differs by more than
    one: members of large buckets meet those of their own level and the next alone.
    """
    # one shuffle serves the least ids and the join that brings them to the others
    spread = posts.repartition("post")
    heads = spread.groupBy("post").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count("*").alias("n")).where("head < last")
    shared = written(spread.join(heads.select("post", "head", "n").hint("shuffle_hash"), "post"), f"{label}-posts", release=True)
    stars = shared.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    if admit is not None:
        near = traits.alias("l").join(stars, F.col("l.id") == F.col("a")).join(traits.alias("r"), F.col("r.id") == F.col("b"))
        stars = near.where(admit("l", "r")).select("a", "b")
    if known is not None:
        joined = written(connected_components(known), f"{label}-known")
        of = [joined.select(F.col("node").alias(n), F.col("component").alias(f"c{n}")) for n in ("a", "b")]
        stars = stars.join(of[0], "a", "left").join(of[1], "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    tried = written(stars, f"{label}-stars", release=True)
    star = verify(tried)
    if known is not None:
        star = star.union(known)
        forget(joined)
    parts = connected_components(star).withColumnRenamed("node", "id")
    # buckets of two ids are settled
    placed = shared.where("n > 2").join(parts, "id", "left").select("id", "post", "n", F.coalesce("component", "id").alias("part"))
    placed = written(placed, f"{label}-parts", release=True)
    forget(shared)
    split = placed.groupBy("post").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("post")
    rest = placed.join(split, "post")
    if traits is not None:
        rest = rest.join(traits, "id")
    large = F.col("n") > (BUCKET_BLOCK if level is None else LEVEL_FROM)
    rest = rest.withColumn("level", F.when(large, F.lit(0).cast("long") if level is None else level)).drop("n")
    rest = written(rest, f"{label}-rest", release=True)
    forget(placed)

    def met(left: DataFrame, right: DataFrame, key: list[str], first: str) -> DataFrame:
        apart = reduce(and_, (F.col(f"l.{k}") == F.col(f"r.{k}") for k in key))
        apart &= F.expr(first) & (F.col("l.part") != F.col("r.part"))
        if admit is not None:
            apart &= admit("l", "r")
        return left.alias("l").join(right.alias("r"), apart).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b"))

    flat = rest.where("level IS NULL")
    pairs = met(flat, flat, ["post"], "l.id < r.id")
    tall = rest.where("level IS NOT NULL").withColumn("at", F.col("level"))
    near = tall if level is None else tall.withColumn("at", F.explode(F.array(F.col("level"), F.col("level") - 1)))
    sizes = near.groupBy("post", "at").agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    sizes = written(sizes.select("post", "at", F.least(F.ceil(F.sqrt(F.col("n") / BUCKET_BLOCK)), F.lit(MOST_BLOCKS)).cast("int").alias("blocks")), f"{label}-sizes")
    cut = sized(sizes)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in its own block, once for every block of the other side."""
        placed = rows.join(cut, ["post", "at"]).withColumn(own, F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks")).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    pairs = pairs.union(met(dealt(tall, "i", "j"), dealt(near, "j", "i"), ["post", "at", "i", "j"], "(l.level < r.level OR l.id < r.id)"))
    more = pairs.distinct().join(tried, ["a", "b"], "left_anti")
    more = written(more, f"{label}-pairs", release=True)
    # the disk is fullest while texts are fetched
    forget(tried, rest, sizes)
    found = written(star.union(verify(more)), f"{label}-links", release=True)
    forget(more)
    return found
