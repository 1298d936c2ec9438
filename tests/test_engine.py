import json
import os

import pytest
from pyspark.sql import functions as F

from siftlog.engine import Engine
from siftlog.operators import aggregate, ordering, search, timeline
from siftlog.plans import catalog
from siftlog.sources import read, write
from siftlog.streaming import ingest
from siftlog.streaming import timeline as stream_timeline


@pytest.fixture(scope="module")
def events(spark):
    rows = [(i, i * 1000, ["error", "view", "click"][i % 3], float(i), json.dumps({"k": i} if i % 2 else {"k": str(i)})) for i in range(-3, 30)]
    df = spark.createDataFrame(rows, "id long, ms long, kind string, value double, props string")
    return df.withColumn("ts", F.timestamp_millis("ms")).cache()


@pytest.fixture
def engine(spark, events):
    e = Engine(spark)
    e.register("events", events, "ts", ("props",))
    return e


def test_one_aggregation(engine):
    with pytest.raises(search.ArgumentError):
        engine.search("events", count=True, min="value")
    with pytest.raises(search.ArgumentError):
        engine.search("events", count=True, columns=["id"])


def test_aggregations(engine):
    assert engine.search("events", "kind: none", count=True).collect() == []
    assert engine.search("events", "kind: error", count=True).first()[0] == 11
    buckets = {r["timestamp"]: r["count"] for r in engine.search("events", count_by_time=5000).collect()}
    assert buckets[0] == 8 and buckets[25000] == 5  # towards zero: -3..4 fall together
    assert engine.search("events", "id > 3", min="value").first()["min"] == 4.0
    assert engine.search("events", min="kind").collect() == []
    kinds = aggregate.unique_ordered(engine.search("events", "id >= 0 AND id < 3", unique="props.k")).collect()
    assert [(r["type"], r["value"]) for r in kinds] == [("int", "1"), ("string", "0"), ("string", "2")]
    assert engine.search("events", max="props.k").first()["max"] == 29.0
    with pytest.raises(search.ArgumentError):
        engine.search("events", max="a.*")


def test_unique_types(spark):
    df = spark.createDataFrame([(x,) for x in ['{"x":1}', '{"x":1.0}', '{"x":"1"}', '{"x":true}', '{"x":null}', '{"x":[1]}', '{"x":1}', "{}"]], "j string").select(F.parse_json("j").alias("j"))
    got = aggregate.unique_ordered(aggregate.unique(df, "x", "j")).collect()
    assert [(r["type"], float(r["value"]) if r["type_rank"] < 2 else r["value"]) for r in got] == [("int", 1.0), ("float", 1.0), ("string", "1"), ("bool", "true")]


def test_exact_extremes(spark):
    df = spark.createDataFrame([('{"x":9007199254740993}',), ('{"x":9007199254740992.0}',)], "j string").select(F.parse_json("j").alias("j"))
    assert aggregate.extreme(df, "x", "max", "j").first()["int_value"] == 9007199254740993
    assert aggregate.extreme(df, "x", "min", "j").first()["float_value"] == 9007199254740992.0
    big = spark.createDataFrame([('{"x":1}',), ('{"x":1e300}',), ('{"x":-1e300}',)], "j string").select(F.parse_json("j").alias("j"))
    assert aggregate.extreme(big, "x", "max", "j").first()["max"] == 1e300
    assert aggregate.extreme(big, "x", "min", "j").first()["min"] == -1e300


def test_time_ranges(engine, events):
    assert engine.search("events", tge=1000, tle=3000).count() == 3
    with pytest.raises(search.ArgumentError):
        engine.search("events", tge=2, tle=1)
    with pytest.raises(search.ArgumentError):
        search.time_filter(events, None, tge=1)
    with pytest.raises(search.ArgumentError):
        search.time_filter(events, "ts", teq=1, tle=5)
    assert search.time_filter(events, "ts", tgt=1000, tlt=3000).count() == 1
    assert search.time_filter(events, "ts", teq=1000).count() == 1


def test_projection(spark, events):
    df = events.withColumn("s", F.struct(F.col("id").alias("a"), F.struct("kind").alias("b")))
    assert search.project(df, ["s.a", "s.b.kind"]).columns == ["s.a", "s.b.kind"]
    for bad in (["s"], ["s.*"], ["none"], ["id", "id"]):
        with pytest.raises(search.ArgumentError):
            search.project(df, bad)
    assert search.project(df, ["id", "id"], allow_duplicates=True).columns == ["id", "id"]
    v = spark.createDataFrame([('{"a":{"b":1,"c":[1,2]},"d\\"q":null,"e":{}}',)], "j string").select(F.parse_json("j").alias("j"))
    assert search.project_json(v, ["a.c", "a.x", 'd\\"q', "z.y"], "j").first()[0] == '{"a":{"c":[1,2]},"d\\"q":null}'


def test_order(spark, events):
    top = [r["id"] for r in ordering.latest(events, "ts", 3, ["id"]).collect()]
    assert top == [29, 28, 27]
    with pytest.raises(search.ArgumentError):
        ordering.latest(events, "ts", 0)
    assert [r["id"] for r in ordering.page(events, 2, 5, "ts", "id").collect()] == [24, 23, 22, 21, 20]
    days = [(k, k * 10_000, k * 10_000 + 9_999) for k in range(3)]
    seen = []

    def reader(keys):
        seen.extend(keys)
        return events.where(F.floor(F.col("ms") / 10_000).isin(keys))

    assert [r["id"] for r in ordering.latest_with_stop(days, reader, "ms", 4, ["id"], 1).collect()] == [29, 28, 27, 26]
    assert seen == [2]


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, None)], "id int, t int")
    assert [r["id"] for r in ordering.latest(df, "t", 2, ["id"]).collect()] == [1, 2]
    assert ordering.latest(df, "t", 9, ["id"]).count() == 4


def test_chunks(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(25)], "i int, s string")
    chunks = ordering.chunked(df, "i", F.length("s"), 30)
    assert [r["chunk"] for r in chunks.orderBy("i").collect()] == [i // 3 for i in range(25)]
    last = [r for r in ordering.chunk_index(chunks, "i").collect() if r["is_last_chunk"]]
    assert [(r["chunk"], r["begin_ix"], r["end_ix"]) for r in last] == [(8, 24, 25)]


def test_archives(spark):
    a = spark.createDataFrame([("a", 0, 10), ("b", 5, 20), ("c", 0, 0), ("d", 30, 40)], "id string, begin_timestamp long, end_timestamp long")
    assert [r["id"] for r in ordering.archives_for(a, 8, 35).collect()] == ["d", "b", "a"]
    assert {r["id"] for r in ordering.retained(a, 15).collect()} == {"b", "c", "d"}
    assert {r["id"] for r in ordering.expired(a, 15).collect()} == {"a"}
    assert aggregate.space_savings({"x": spark.createDataFrame([], "uncompressed_size long, size long")}).first()["savings"] is None


def test_multiple_datasets(spark):
    e = Engine(spark)
    e.register("one", spark.createDataFrame([(1, "x")], "a int, b string"))
    e.register("two", spark.createDataFrame([(1, 2)], "a int, c int"))
    assert {(r["dataset"], r["b"], r["c"]) for r in e.search(["one", "two"], "a: 1").collect()} == {("one", "x", None), ("two", None, 2)}
    assert e.list() == ["one", "two"]
    e.drop("two")
    assert e.list() == ["one"]


def test_guided(engine, spark):
    got = engine.guided("events", "id, value", "ms", "0", "5000", "kind = 'view' OR kind = 'click'", "id DESC", 3)
    assert [r["id"] for r in got.collect()] == [5, 4, 2]
    for kind, text in (("where", "1 = 1); DROP TABLE x"), ("select", "a FROM b; x"), ("order", "a,,b"), ("where", "(a = 1")):
        with pytest.raises(timeline.FragmentError):
            timeline.check_fragment(spark, kind, text)


def test_timeline(events):
    got = [(r["idx"], r["timestamp"], r["count"]) for r in timeline.guided_timeline(events, "ts", 0, 40, 4).orderBy("idx").collect()]
    assert got == [(1, 0.0, 10), (2, 10.0, 10), (3, 20.0, 10), (4, 30.0, 0)]
    assert timeline.bucket_size(0, 3_600_000, 60) == 60_000
    assert timeline.expanded(61_000, 119_000, 60_000) == (60_000, 120_000)


def test_catalog(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":1,"c":{}},"l":[1]}'), (2, '{"a":{"b":"x"},"n":null}'), (3, "broken")], "id int, j string")
    got = {(r["name"], r["type"]) for r in catalog.column_index(df, ("j",)).collect()}
    assert got == {("id", "int"), ("j.a.b", "bigint"), ("j.a.b", "string"), ("j.a.c", "object"), ("j.l", "array"), ("j.n", "void")}


def test_json_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = ['{"ts":"2024-01-10 00:00:00","a":1}', "", "5", '{"a":', '{"ts":1704844800000,"a":"1"}', '{"a":1,"a":2}']
    (tmp_path / "log" / "x.jsonl").write_text("\n".join(lines))
    df = read.read_records(spark, str(tmp_path / "log"), "ts", remove_prefix=str(tmp_path))
    rows = df.collect()
    assert sorted(r["rejected"] for r in rows if r["rejected"]) == sorted(["5", '{"a":', '{"a":1,"a":2}'])
    assert [r["ts_ns"] for r in rows if r["record"] is not None] == [1704844800 * 10**9] * 2
    assert {r["orig_file_path"] for r in rows} == {"/log/x.jsonl"}


def test_sniffing(spark, tmp_path):
    heads = {"a": b'{"x":1}', "b": b'{"auto":{},"user":{}}', "c": b"2024 hello", "e": b"\x28\xb5\x2f\xfdxx", "f": b"\x1f\x8bxx", "g": b"PAR1", "h": b"\0\1\2"}
    assert read.sniff(b"") == "empty"
    (tmp_path / "s").mkdir()
    for name, head in heads.items():
        (tmp_path / "s" / name).write_bytes(head)
    got = {os.path.basename(r["path"]): r["kind"] for r in read.sniff_files(spark, [str(tmp_path / "s")]).collect()}
    assert got == {"a": "json", "b": "pairs", "c": "text", "e": "zstd", "f": "gzip", "g": "archive", "h": "unknown"}


def test_pairs(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"auto":{"level":"INFO"},"user":{"x":1}}\n{"auto":{},"user":{"x":2}}\n')
    from siftlog.kql.compile import compile_query

    df = read.read_pairs(spark, str(tmp_path / "p.jsonl"))
    assert df.where(compile_query(df.drop("orig_file_path"), "@level: INFO AND x: 1", root="user", namespaces={"@": ["auto"]})).count() == 1


LOG = "before\n2024-01-10 00:00:00.123 first\n  at x\n  at y\n[20170106-16:56:41] second\nJan 10, 2024 01:02:03 PM third\nmore\n"


def test_text_events(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    rows = read.group_events(read.read_text_lines(spark, str(tmp_path / "a.log"))).orderBy("event_ix").collect()
    assert [r["message"].split("\n") for r in rows] == [["before"], ["2024-01-10 00:00:00.123 first", "  at x", "  at y"], ["[20170106-16:56:41] second"], ["Jan 10, 2024 01:02:03 PM third", "more"]]
    assert [r["ts_ns"] for r in rows][:2] == [None, 1704844800123 * 10**6]
    records = [json.loads(r["message"]) for r in read.text_to_records(spark.createDataFrame(rows)).collect()]
    assert [sorted(r) for r in records] == [["message"], ["message", "timestamp"], ["message", "timestamp"], ["message", "timestamp"]]


def test_compress_and_extract(spark, tmp_path):
    rows = [{"a": i, "f": i / 7, "s": "x y", "n": None, "l": [1, {"b": []}], "o": {}} for i in range(50)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    e = Engine(spark)
    row = e.compress(str(tmp_path / "in.jsonl"), str(tmp_path / "archive")).first()
    assert row["num_messages"] == 50 and row["end_timestamp"] == 0
    write.extract(spark.read.parquet(str(tmp_path / "archive")), str(tmp_path / "out"), order="log_event_idx")
    again = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(again, key=lambda r: r["a"]) == rows
    (tmp_path / "b.log").write_text(LOG)
    row = e.compress(str(tmp_path / "b.log"), str(tmp_path / "texts"), unstructured=True).first()
    assert row["num_messages"] == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"m{i}", "/f", "a", i) for i in range(20)], "timestamp long, message string, orig_file_path string, archive_id string, log_event_ix long")
    assert sorted(write.to_lines(df))[:2] == ["m0", "m1"]
    write.to_results(df, str(tmp_path / "r"), 5, "d")
    got = read.read_results(spark, str(tmp_path / "r"), 2).collect()
    assert [(r["id"], r["dataset"]) for r in got] == [("a-19", "d"), ("a-18", "d")]
    write.to_files(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 20
    write.write_archive(df, str(tmp_path / "z"), order="timestamp", bloom_columns=["message"], records_per_file=10)
    write.extract_stream(spark.read.parquet(str(tmp_path / "z")).withColumnRenamed("log_event_ix", "log_event_idx"), str(tmp_path / "v"), "/f", 3, 6)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()) == ["m3", "m4", "m5"]
    assert write.tagged(aggregate.count(df), "a").first()["archive_id"] == "a"


def test_observation(engine, events):
    df, seen = engine.observed(engine.search("events", "kind: error"))
    df.collect()
    assert seen.get["rows"] == 11


def test_template_search_is_plain_search(spark):
    from siftlog.functions import logtype

    df = spark.createDataFrame([("took 5 ms for user=bob",), ("took five ms",), ("user=bobby took 7",), ("deadbeef took it",)], "message string").withColumn("logtype", logtype.logtype(F.col("message")))
    for p in ("took 5", " took ", "bob", "user=b", "*ms*", "took * ms", "deadbeef took it"):
        assert sorted(r["message"] for r in search.search_by_template(df, p).collect()) == sorted(r["message"] for r in search.text_search(df, p).collect()), p


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "ts timestamp, kind string"

    def put(name, rows):
        (source / name).write_text("\n".join(json.dumps({"ts": t, "kind": k}) for t, k in rows))

    put("1.json", [("2024-01-01 00:00:01", "a"), ("2024-01-01 00:00:30", "b"), ("2024-01-01 00:01:10", "a")])

    def run():
        stream = ingest.file_stream(spark, str(source), schema)
        ingest.ingest(stream, str(tmp_path / "archive"), str(tmp_path / "c1")).awaitTermination()
        found = stream_timeline.search_stream(ingest.file_stream(spark, str(source), schema), "kind: a")
        stream_timeline.publish(stream_timeline.counts(found, "ts", "1 minute", "10 minutes"), str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination()
        return {r["timestamp"]: r["count"] for r in stream_timeline.latest(spark, str(tmp_path / "t")).collect()}

    first = 1704067200000
    assert run() == {first: 1, first + 60000: 1}
    put("2.json", [("2024-01-01 00:00:05", "a"), ("2024-01-01 00:02:05", "c")])
    assert run() == {first: 2, first + 60000: 1}
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 5


def test_buffer():
    now, out = [0.0], []
    b = ingest.Buffer(100, 10, lambda e: out.append(list(e)), lambda: now[0])
    b.add("a", 60)
    b.tick()
    assert out == []
    b.add("b", 40)
    assert out == [[("a", 60), ("b", 40)]]
    b.add("c", 1)
    now[0] = 9
    b.add("d", 1)
    now[0] = 10
    b.tick()
    assert out[1:] == [[("c", 1), ("d", 1)]]
    b.add("e", 1)
    b.close()
    b.close()
    assert out[2:] == [[("e", 1)]]


def test_grouping_files(spark):
    df = spark.createDataFrame([(f"/x/a{i}.log", 40) for i in range(5)] + [("/x/b.log", 500)], "path string, size long")
    got = {r["path"]: (r["name_group"], r["part"]) for r in ingest.group_files(df, 100).collect()}
    assert [got[f"/x/a{i}.log"] for i in range(5)] == [("a#.log", 0), ("a#.log", 0), ("a#.log", 0), ("a#.log", 1), ("a#.log", 1)]
    assert [r["path"] for r in ingest.scan_prefix(df, "/x/a3.log").collect()] == ["/x/a4.log", "/x/b.log"]


def test_chunks_of_many_rows(spark, tmp_path):
    df = spark.range(0, 300_000, 1, 12).select(F.col("id").alias("i"), (F.col("id") % 7).cast("string").alias("s"), F.lit("x").alias("part"))
    df.orderBy(F.xxhash64("i")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    found = ordering.chunked(rows, "i", F.lit(10), 1000)
    assert found.columns == ["i", "s", "part", "chunk"]
    wrong = found.agg(F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.sum((F.col("chunk") != F.floor(F.col("i") / 100)).cast("int")).alias("wrong")).first()
    assert tuple(wrong) == (300_000, 300_000, 0)
    index = ordering.chunk_index(found, "i").orderBy("chunk").collect()
    assert [(r["begin_ix"], r["end_ix"]) for r in index] == [(100 * k, 100 * k + 100) for k in range(3000)]
    assert [r["chunk"] for r in index if r["is_last_chunk"]] == [2999]


def test_datasets_with_unlike_times(spark):
    a = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01 00:00:01'), (2, TIMESTAMP '2024-01-01 00:01:01') AS t(id, at)")
    b = spark.sql("SELECT * FROM VALUES (3, 1704067230000000000L, parse_json('{\"k\": 5}')), (4, 1704067320000000000L, parse_json('{\"k\": 2}')) AS t(id, ns, body)")
    e = Engine(spark)
    e.register("a", a, "at")
    e.register("b", b, "ns", root="body")
    e.register("c", a)
    counts = {r["timestamp"]: r["count"] for r in e.search(["a", "b"], count_by_time=60_000).collect()}
    assert counts == {1704067200000: 2, 1704067260000: 1, 1704067320000: 1}
    newest = e.search(["a", "b"], max_results=2)
    assert sorted(r["id"] for r in newest.collect()) == [2, 4]
    assert newest.columns == ["id", "at", "dataset", "ns", "body"]
    assert [r["id"] for r in e.search(["a", "b"], max_results=1, columns=["id"]).collect()] == [4]
    assert e.search(["a", "b"], max="k").first()["int_value"] == 5
    with pytest.raises(search.ArgumentError):
        e.search(["a", "c"], count_by_time=1000)
