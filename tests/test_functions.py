import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlog.functions import logtype, presto, timestamps


@pytest.mark.parametrize(
    ("text", "nanos", "resolved"),
    [
        ("2024-01-10 00:00:00", 1704844800 * 10**9, "§Y-§m-§d §H:§M:§S"),
        ("2015-01-31T15:50:45.392Z", 1422719445392 * 10**6, "§Y-§m-§dT§H:§M:§S.§3Z"),
        ("2015/01/31 15:50:45,39", 142271944539 * 10**7, "§Y/§m/§d §H:§M:§S,§T"),
        ("[20170106-16:56:41]", 1483721801 * 10**9, "[§Y§m§d-§H:§M:§S]"),
        ("1706980946603", 1706980946603 * 10**6, "§L"),
        ("1706980946.603", 1706980946603 * 10**6, "§E.§3"),
        ("-5", -5 * 10**9, "§E"),
        ("2016-12-31 23:59:60+01:00", 1483225200 * 10**9, "§Y-§m-§d §H:§M:§J§z{+01:00}"),
    ],
)
def test_timestamps(text, nanos, resolved):
    resolved = resolved.replace("§", "\\")
    assert timestamps.parse(text) == (nanos, resolved)
    assert timestamps.render(nanos, resolved) == text


@pytest.mark.parametrize("text", ["2024-02-30 00:00:00", "yesterday", "", "2024-01-10", "Mon Jan  3 15:50:45 2017"])
def test_no_timestamp(text):
    assert timestamps.parse(text) is None


@pytest.mark.parametrize("pattern", [r"\q", r"\Y\Y", r"\E \H", '"', r"\B{a,b}", r"\O{}", "\x01"])
def test_bad_patterns(pattern):
    with pytest.raises(timestamps.PatternError):
        timestamps.parts_of(pattern)


def test_every_default_pattern_parses_its_own_rendering():
    moment = 1483372245 * 10**9 + 123_000_000
    for pattern in timestamps.DATE_PATTERNS:
        fixed = pattern
        for kind, plain in (("O{-/}", "-"), ("O{T }", " "), ("O{,.}", "."), ("O{- }", "-"), ("Z", "Z")):
            fixed = fixed.replace("\\" + kind, plain)
        text = timestamps.render(moment, fixed.replace("\\?", "\\3").replace("\\s", "\\S"))
        assert timestamps.parse(text, pattern) is not None, pattern


@settings(max_examples=100, deadline=None)
@given(st.integers(-(10**9), 4 * 10**9), st.integers(0, 10**9 - 1))
def test_round_trip(seconds, nano):
    for short, unit in (("Y-m-d H:M:S.9", 1), ("ymd k:M:S.6" if 0 <= seconds < 10**9 else "Ymd H:M:S.6", 1000)):
        pattern = "".join("\\" + c if c.isalnum() else c for c in short)
        moment = seconds * 10**9 + nano // unit * unit
        assert timestamps.parse(timestamps.render(moment, pattern), pattern)[0] == moment


def test_precision_columns(spark):
    values = [1, 31536000, 31536001 * 1000, 31536001 * 10**6, 31536001 * 10**9, -5]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(timestamps.precision_of(F.col("v")), timestamps.epoch_to_ns(F.col("v"))).collect()
    assert [r[0] for r in rows] == [timestamps.epoch_precision(v) for v in values]
    assert [r[1] for r in rows] == [10**9, 31536000 * 10**9, 31536001 * 10**9, 31536001 * 10**9, 31536001 * 10**9, -5 * 10**9]


def test_parse_column(spark):
    texts = ["2024-01-10 00:00:00", "2024-01-10T00:00:00Z", "nothing", None, "1706980946603", "Jan 10, 2024 01:02:03 PM", "2024-13-01 00:00:00"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(timestamps.parse_column(F.col("t"))).collect()]
    assert got == [None if t is None or (f := timestamps.parse(t)) is None else f[0] for t in texts]


def test_legacy_patterns():
    assert timestamps.parse("01.02.2015 01:02:03.004", timestamps.from_legacy("%d.%m.%Y %H:%M:%S.%3"))[0] == 1422752523004 * 10**6
    with pytest.raises(timestamps.PatternError):
        timestamps.from_legacy("%Q")


MESSAGES = ["INFO task_12 took 3.25 s user=bob id=0x1f deadbeef -5 a=-- fe", "x\\y \x11 12 \x13", "", "no vars here", "k=v=1 ab cd. 1.2.3 1234567890123456789012", "=a", "-0 00 0.10 1.", "é1é"]


def test_templates(spark):
    df = spark.createDataFrame([(m,) for m in MESSAGES], "m string")
    rows = df.select("m", logtype.logtype(F.col("m")), logtype.variables(F.col("m")), logtype.rebuild(logtype.logtype(F.col("m")), logtype.variables(F.col("m")))).collect()
    for m, template, found, again in rows:
        assert (template, found) == logtype.encode_python(m)
        assert again == m


@settings(max_examples=200, deadline=None)
@given(st.text("a1=.-\\ \x11\x12\x13fx_é", max_size=30))
def test_templates_keep_messages(message):
    assert logtype.decode_python(*logtype.encode_python(message)) == message


def test_user_schema(spark):
    delimiters, names = logtype.parse_schema("// comment\ndelimiters: \\t\nint:-?[0-9]+\nuser:uid=(?<id>\\w+)\n")
    assert delimiters == " \t" and list(names) == ["int", "user"]
    got = spark.createDataFrame([("a -5 uid=bob 7",)], "m string").select(logtype.schema_variables(F.col("m"), names)).first()[0]
    assert got == {"int": ["-5", "7"], "user": ["bob"]}


def test_dialect(spark):
    df = spark.createDataFrame([(1, "e\u0301"), (2, "x"), (3, None)], "a int, t string")
    assert [r[0] for r in df.select(presto.normalize(F.col("t"))).collect()] == ["é", "x", None]
    none = df.where("a > 5").select("a")
    assert presto.quantified(df, "a", ">", "ALL", none).count() == 3
    assert presto.quantified(df, "a", ">", "ANY", none).count() == 0
    assert [r.a for r in presto.quantified(df, "a", ">=", "ALL", df.select("a")).collect()] == [3]
    assert presto.quantified(df, "a", ">", "ALL", spark.createDataFrame([(0,), (None,)], "x int")).count() == 0
    t = spark.sql("SELECT 1.5D AS s").select(presto.to_unixtime(presto.from_unixtime(F.col("s")))).first()[0]
    assert t == 1.5

