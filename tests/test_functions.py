import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import formats, levels, text, timeparse
from tidelog.operators import exceptions, parsing, roles, sequence, state, temporal


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(
    "stamp, want",
    [
        ("2024-01-02T03:04:05Z x", 1704164645000.0),
        ("2024-01-02 03:04:05,678", 1704164645678.0),
        ("2024-01-02T03:04:05+0200", 1704157445000.0),
        ("2024/01/02 03:04:05", 1704164645000.0),
        ("Tue Jan 2 03:04:05 2024", 1704164645000.0),
        ("02/Jan/2024:03:04:05 +0100", 1704161045000.0),
        ("Jan  2 03:04:05 host", 1704164645000.0),
        ("03:04:05.5", 1704078245500.0),
        ("2024-02-30 00:00:00", None),
        ("2024-01-02 25:00:00", None),
        ("no time", None),
        ("", None),
    ],
)
def test_parse_timestamp(spark, stamp, want):
    assert one(spark, timeparse.parse_timestamp(F.col("t")), t=stamp) == want


def test_zone_of_naive_stamps(spark):
    assert one(spark, timeparse.parse_timestamp(F.col("t"), "Europe/Berlin"), t="2024-01-02 03:04:05") == 1704161045000.0
    assert one(spark, timeparse.parse_timestamp(F.col("t"), "Europe/Berlin"), t="02/Jan/2024:03:04:05") == 1704164645000.0


@pytest.mark.parametrize("value, want", [("1704164645", 1704164645000.0), ("1704164645000", 1704164645000.0), ("1704164645000000", 1704164645000.0), ("1704164645000000000", 1704164645000.0), ("12", None)])
def test_epoch_by_size(spark, value, want):
    assert one(spark, timeparse.coerce_timestamp(F.col("t")), t=value) == want


def test_other_stamps(spark):
    assert one(spark, timeparse.compact_ms(F.col("t")), t="20240102030405+0100") == 1704161045000.0
    assert one(spark, timeparse.us_date_ms(F.col("d"), F.col("t")), d="1/2/24", t="3:04:05 PM") == 1704207845000.0
    assert one(spark, timeparse.ms_to_iso(F.lit(1704164645678.0)), t="") == "2024-01-02T03:04:05.678Z"


@pytest.mark.parametrize("word, want", [("Warning", "WARN"), ("SEVERE", "ERROR"), ("crit", "FATAL"), ("odd", "ODD"), ("", ""), (None, "")])
def test_levels(spark, word, want):
    assert one(spark, levels.canonical_level(F.col("w")), w=word) == want


@pytest.mark.parametrize("line", ["ok=False", "failed: 1", "errors=0 failures=2", "status=503", "rc=-1", "unable to open", "timed out", "timeout exceeded", "connection refused"])
def test_escalates(spark, line):
    assert one(spark, levels.content_reason(F.col("t")), t=line) is not None


@pytest.mark.parametrize("line", ["ok=true", "errors=0", "failed=0", "status=200", "exit=0", "timeout configured as 30s", "all fine", ""])
def test_does_not_escalate(spark, line):
    assert one(spark, levels.content_reason(F.col("t")), t=line) is None


def expected_fingerprint(s: str) -> str:
    s = re.sub(r"0x[0-9a-fA-F]+", "0xHEX", s)
    s = re.sub(r"[A-Za-z]:[\\/][^\s:'\",)\]]+", "/PATH", s)
    s = re.sub(r"\s+", " ", re.sub(r"\d+", "N", re.sub(r"/[^\s:]+", "/PATH", s))).strip()
    return hashlib.sha1(s.encode()).hexdigest()[:12]


@pytest.mark.parametrize("line", ["boom at 0x1d in C:\\a\\b.py, user_42", "open /tmp/x/y failed:  12", "a\tb  3"])
def test_fingerprint(spark, line):
    assert one(spark, text.fingerprint(F.col("t")), t=line) == expected_fingerprint(line)


def test_fields_and_addresses(spark):
    line = "tex0=0x0000000804000010 a=1 a=2 size=0xABCDEF n:7"
    row = spark.createDataFrame([(line,)], "t string").select(text.fields(F.col("t")), text.addresses(F.col("t"))).first()
    assert row[0]["a"] == "2" and row[0]["tex0"] == "0x0000000804000010" and row[1] == ["0x804000010", "0xabcdef"]
    found = roles.address_roles(spark.createDataFrame([(line, 3)], "line string, repeat int"), "line", "repeat").collect()
    assert [(r["address"], r["role"], r["n"]) for r in found] == [("0x804000010", "tex0", 3)]


def test_sizes(spark):
    assert one(spark, text.parse_bytes(F.col("t")), t="1.5KB") == 1536
    assert one(spark, text.human_size(F.lit(1536)), t="") == "1.5 KB"


GOLDEN = [
    ("2026-07-20 12:00:00.123 [main] WARN  com.acme.Foo - low", "log4j", "WARN"),
    ('10.0.0.1 - - [20/Jul/2026:12:00:00 +0200] "GET / HTTP/1.1" 503 12', "clf_combined", "ERROR"),
    ("I0102 03:04:05.000006    12 main.go:7] hello", "klog", "INFO"),
    ("2024/01/02 03:04:05 [error] 12#34: *5 open() failed", "nginx_error", "ERROR"),
    ("01-02 03:04:05.678  1000  1001 E ActivityManager: crash", "logcat_threadtime", "ERROR"),
    ("<34>1 2003-10-11T22:14:15.003Z host su - ID47 - hi", "syslog5424", "FATAL"),
    ("npm ERR! code 1", "npm", "ERROR"),
    ("src/a.c:3:4: warning: unused", "gcc", "WARN"),
    ("2024-01-02 03:04:05.678 UTC [12] ERROR:  relation missing", "postgres", "ERROR"),
]


@pytest.mark.parametrize("line, name, level", GOLDEN)
def test_golden_lines(spark, line, name, level):
    f = formats.FORMATS[name]
    parsed = spark.createDataFrame([(line,)], "l string").select(f.parsed(F.col("l")).alias("e")).first()["e"]
    assert parsed is not None and parsed["adapter"] == name and parsed["level"] == level


def test_golden_lines_are_detected_as_themselves(spark):
    lines = spark.createDataFrame([(name, 0, line) for line, name, _ in GOLDEN], "source string, no int, line string")
    assert all(r["source"] == r["adapter"] for r in parsing.detect(lines, "source", "line", ["no"]).collect())


def test_parse_loses_no_line(spark):
    rows = [("a", 0, "hello"), ("a", 1, '{"ts": 1700000000, "level": 50, "msg": "x", "k": 1}'), ("b", 0, "level=error msg=q ts=2024-01-01T00:00:00Z"), ("b", 1, "[1, 2"), ("c", 0, "ok=False")]
    lines = spark.createDataFrame(rows, "source string, no int, line string")
    got = {(r["source"], r["no"]): r for r in parsing.normalised(lines, "source", "line", ["no"]).collect()}
    assert len(got) == len(rows)
    assert got["a", 1]["adapter"] == "structural" or got["a", 1]["level"] == "ERROR"
    assert got["b", 0]["level"] == "ERROR" and got["b", 0]["ts_ms"] == 1704067200000.0
    assert got["c", 0]["level"] == "WARN" and got["c", 0]["escalation_reason"] == "ok=false"


@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=40), min_size=1, max_size=6))
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
def test_structural_reading_is_total(spark, lines):
    frame = spark.createDataFrame([(x,) for x in lines], "l string")
    got = frame.select(formats.structural(F.col("l"), formats.pairs(F.col("l"))).alias("e"), timeparse.parse_timestamp(F.col("l")).alias("t")).collect()
    assert len(got) == len(lines) and all(r["e"]["data"]["shape"] for r in got)


BLOCKS = [
    ("python", "Traceback (most recent call last):\n  File \"a.py\", line 3, in f\n    g()\n  File \"b.py\", line 9, in g\n    x[1]\nKeyError: 'k'", "KeyError", 2),
    ("java", 'Exception in thread "main" java.lang.RuntimeException: outer\n\tat a.B.c(B.java:10)\nCaused by: java.lang.NullPointerException: inner\n\tat a.B.d(B.java:20)', "NullPointerException", 2),
    ("go", "panic: runtime error: index out of range\n\ngoroutine 1 [running]:\nmain.main()\n\t/x/main.go:12 +0x1", "panic", 1),
    ("node", "TypeError: x is not a function\n    at foo (/a/b.js:3:5)\n    at bar (/a/c.js:4:1)", "TypeError", 2),
    ("rust", "thread 'main' panicked at src/main.rs:2:5:\nboom", "panic", 1),
    ("ruby", "app.rb:3:in `foo': undefined method `x' for nil (NoMethodError)\n\tfrom app.rb:9:in `<main>'", "NoMethodError", 2),
    ("cpp", "terminate called after throwing an instance of 'std::out_of_range'\n  what():  vector", "std::out_of_range", 0),
    ("dotnet", "Unhandled exception. System.InvalidOperationException: seq\n ---> System.ArgumentException: inner\n   at A.B.C(String x) in C:\\x\\y.cs:line 4", "ArgumentException", 1),
    ("php", "PHP Fatal error:  Uncaught Exception: bad in /a/x.php:3\nStack trace:\n#0 /a/y.php(4): foo()", "Exception", 1),
]


def test_exceptions_of_nine_languages(spark):
    frame = spark.createDataFrame([(b[1],) for b in BLOCKS] + [("no error",)], "b string")
    got = {r["b"]: r for r in exceptions.parse_exceptions(frame, "b").collect()}
    for lang, block, kind, n in BLOCKS:
        assert (got[block]["language"], got[block]["type"], len(got[block]["frames"])) == (lang, kind, n), lang
    assert got["no error"]["language"] is None


def test_blocks_are_assembled_in_order(spark):
    lines = spark.createDataFrame([("s", 0, "A"), ("s", 1, "  x"), ("s", 2, "B"), ("s", 3, "  y")], "src string, no int, line string")
    got = exceptions.blocks(lines, ["src"], "no", "line", ~F.col("line").startswith(" ")).orderBy("first").collect()
    assert [r["block"] for r in got] == ["A\n  x", "B\n  y"]


def test_as_of_carries_over_buckets(spark):
    probes = spark.createDataFrame([("a", 10, 1), ("a", 999_999_999, 2), ("b", 5, 3)], "k string, ts_ms long, id int")
    states = spark.createDataFrame([("a", 10, "x"), ("a", 20, "y")], "k string, s_ts_ms long, v string")
    got = {r["id"]: r["state"] and r["state"]["v"] for r in temporal.as_of(probes, states, ["k"], bucket_ms=100).collect()}
    assert got == {1: "x", 2: "y", 3: None}
    near = {r["id"]: r["state"] and r["state"]["v"] for r in temporal.nearest(probes.filter("id < 2"), states.filter("v = 'y'"), ["k"], bucket_ms=7).collect()}
    assert near == {1: "y"}


def test_interval_join_includes_ends(spark):
    left = spark.createDataFrame([(1, 100)], "id int, ts_ms long")
    right = spark.createDataFrame([(i,) for i in (69, 70, 100, 110, 111)], "r_ts_ms long")
    assert sorted(r["r_ts_ms"] for r in temporal.interval_join(left, right, 30, 10).collect()) == [70, 100, 110]


def test_flatten_nested(spark):
    got = {r["path"]: r["value"] for r in state.flatten(spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}]}, "d": "x"}'), (2, "not json")], "id int, j string"), ["id"], "j").collect()}
    assert got["a.b[0]"] == "1" and got["d"] == "x" and "a.b[1].c" in got


def test_map_delta(spark):
    frame = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "p map<string,string>, c map<string,string>")
    d = frame.select(state.map_delta(F.col("p"), F.col("c")).alias("d")).first()["d"]
    assert (d["added"], d["removed"], d["changed"]["b"]["to"], d["truncated"]) == ({"c": "4"}, {"a": "1"}, "3", False)


def test_stuck_needs_a_log_that_stands_still(spark):
    rows = [(i, 0, 100) for i in range(6)] + [(i, 0, 100 + i) for i in range(6, 12)]
    frame = spark.createDataFrame([("k", *r) for r in rows], "k string, seq int, d int, bytes int")
    assert [r["seq"] for r in sequence.stuck(frame, ["k"], ["seq"], "d", "bytes").orderBy("seq").collect()] == [4, 5]
