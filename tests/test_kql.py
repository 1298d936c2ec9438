import itertools
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlog.functions import wildcard
from siftlog.kql import parser
from siftlog.kql.compile import compile_query

RECORDS = [
    {"id": 0, "a": "c"},
    {"id": 1, "msg": 'Msg 1: "Abc123"'},
    {"id": 2, "msg": "Msg 4: \\Abc123"},
    {"id": 3, "msg": "Msg 3:\nAbc123"},
    {"id": 7, "arr": [{"b": 1001}, {"b": 5}]},
    {"id": 8, "arr": {"b": 2000}},
    {"id": 9, "v": None, "o": {}, "s": "null", "t": True},
    {"id": 10, "amb": "a*e"},
    {"id": 11, "amb": "abe"},
    {"id": 13, "one": 1},
    {"id": 14, "one": 1.0, "x": {"y": {"b": "q"}}},
    {"id": 15, "list": [1, "two", None, [5]]},
    {"id": 16, "big": 9007199254740993},
    {"id": 17, "big": 9007199254740992.5},
    {"id": 18, "one": "1", "t": "true"},
]

CASES = [
    ("NOT a: b", [0]),
    ('msg: "Msg 1: \\"Abc123\\""', [1]),
    ('msg: "Msg 4: \\\\Abc123"', [2]),
    ('msg: "Msg 3:\\nAbc123"', [3]),
    ('msg: "*Abc123*"', [1, 2, 3]),
    ("arr.b > 1000", [7, 8]),
    ("arr.b: 5", [7]),
    ("arr: { b: 5 AND b: 1001 }", [7]),
    ('amb: "a*e"', [10, 11]),
    ('amb: "a\\*e"', [10]),
    ("one >= 0.5 AND one < 1.5 AND one: 1.0", [13, 14]),
    ("one: 1", [13, 14, 18]),
    ("NOT one: 1", []),
    ("NOT one: 2", [13, 14, 18]),
    ("one: 1.5", []),
    ("t: true", [9, 18]),
    ("v: null", [9]),
    ("s: null", [9]),
    ("NOT s: null", []),
    ("v: *", [9]),
    ("o: *", []),
    ("NOT one: * AND id > 12", [15, 16, 17]),
    ("*.b: q", [14]),
    ("x.*.b: q", [14]),
    ("q", [14]),
    ("list: two", [15]),
    ("list: 5", [15]),
    ("list: null", [15]),
    ("big > 9007199254740992", [16]),
    ("big: 9007199254740993", [16]),
    ("id: 0 OR id: 1 AND NOT a: *", [1]),
    ("id: (OR 1 2)", [1, 2]),
    ("id: (1 2)", [1, 2]),
    ("id: (NOT 1 2) AND msg: *", [3]),
    ('id: timestamp("0.000000007")', [7]),
    ("nothing: 5", []),
    ("NOT nothing: 5", []),
    ("x.y.b: Q", []),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(json.dumps(r),) for r in RECORDS], "j string").select(F.parse_json("j").alias("j")).cache()


def ids(df):
    return sorted(r[0] for r in df.select(F.variant_get("j", "$.id", "int")).collect())


@pytest.mark.parametrize(("text", "want"), CASES)
def test_search(records, text, want):
    assert ids(records.where(compile_query(records, text, root="j"))) == want


def test_ignore_case(records):
    assert ids(records.where(compile_query(records, "x.y.b: Q", root="j", ignore_case=True))) == [14]
    assert ids(records.where(compile_query(records, "msg: *ABC*", root="j", ignore_case=True))) == [1, 2, 3]


@pytest.mark.parametrize(
    "text",
    ["", "a:", "(a: b", "a: b)", "a..b: 1", "a: { @b: 1 }", "a: ()", 'a: timestamp("never")', 'a: timestamp("1", "\\q")', "par*t: 1", "a: \\q", "AND a: b", "a > (1)"],
)
def test_invalid(text):
    with pytest.raises(parser.KqlError):
        parser.parse(text)


def test_reserved_namespace(records):
    with pytest.raises(parser.KqlError):
        compile_query(records, "!a: 1", root="j")


def test_precedence_is_equal(spark):
    rows = [dict(zip("abc", bits)) for bits in itertools.product((0, 1), repeat=3)]
    df = spark.createDataFrame(rows)
    got = {(r.a, r.b, r.c) for r in df.where(compile_query(df, "a: 1 OR b: 1 AND c: 1")).collect()}
    assert got == {(r["a"], r["b"], r["c"]) for r in rows if (r["a"] or r["b"]) and r["c"]}


def test_literal_types():
    kinds = {t: parser.literal_of(t).kind for t in ("1", "-5", "1.0", "1e3", "true", "null", "True", "9223372036854775808", "a b", "0x1")}
    assert kinds == {"1": "int", "-5": "int", "1.0": "float", "1e3": "float", "true": "bool", "null": "null", "True": "string", "9223372036854775808": "float", "a b": "string", "0x1": "string"}


def test_paths():
    assert parser.path_of("a\\.b.c") == parser.Path(("a.b", "c"))
    assert parser.path_of("@a.*.*.b") == parser.Path(("a", "*", "b"), "@")
    assert parser.path_of("\\@a") == parser.Path(("@a",))
    assert parser.path_of("*").pure


def test_typed_pushdown(spark, tmp_path):
    spark.range(100).selectExpr("id", "CAST(id AS STRING) AS s").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(compile_query(df, "id > 5 AND s: 7")).select("id")._jdf.queryExecution().toString()
    assert "GreaterThan(id,5)" in plan and "EqualTo(s,7)" in plan


@settings(max_examples=200, deadline=None)
@given(st.text("ab*?\\%_", max_size=8), st.text("ab%_*?\\", max_size=8))
def test_like_is_the_naive_matcher(pattern, value):
    import re

    like = wildcard.to_like(pattern)
    out, i = [], 0
    while i < len(like):
        c = like[i]
        if c == "\\":
            i += 1
            out.append(re.escape(like[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(c, re.escape(c)))
        i += 1
    assert bool(re.fullmatch("".join(out), value, re.DOTALL)) == wildcard.naive_match(value, pattern)


def test_wildcards_in_spark(spark):
    values = ["", "a", "ab", "a%b", "a_b", "a\\b", "aXb", "a*b", "äb", "a\nb"]
    patterns = ["", "*", "?", "a*", "*b", "a?b", "a\\*b", "a%b", "a_b", "a\\\\b", "*\\?*", "??"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    row = {p: {r.v for r in df.where(wildcard.matches(F.col("v"), p)).collect()} for p in patterns}
    assert row == {p: {v for v in values if wildcard.naive_match(v, p)} for p in patterns}


@pytest.mark.parametrize(("expression", "want"), [("^a.*b$", "a*b"), ("a", "*a*"), ("a.+", "*a?*"), ("^a\\.[b]c$", "a.bc"), ("^$", ""), ("^a\\*$", "a\\*")])
def test_regex_to_wildcard(expression, want):
    assert wildcard.from_regex(expression) == want


@pytest.mark.parametrize("expression", ["a|b", "a+", "(a)", "[a-z]", "\\d", "a{2}", "[ab]", "a?"])
def test_regex_unsupported(expression):
    with pytest.raises(wildcard.UnsupportedRegex):
        wildcard.from_regex(expression)
