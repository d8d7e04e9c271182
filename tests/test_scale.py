"""Operators that no hot key stops: against plain versions, with stretches and runs made small."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidelog.functions import codesigns, formats, timeparse
from tidelog.operators import errors, exceptions, lineage, parsing, predicates, ranks, records, sequence, signals
from tidelog.plans import catalogue
from tidelog.streaming import stream


def history(seed, n=600, keys="abc"):
    rng = random.Random(seed)
    rows, at = [], {k: 0.0 for k in keys}
    for i in range(n):
        k = rng.choice(keys)
        at[k] += rng.choice([0, 0.5, 1, 3, 3, 8, 40])
        rows.append((k, at[k], i, rng.choice([None, 1.5, 2.0, rng.random() * 100])))
    rng.shuffle(rows)
    return rows


SCHEMA = "k string, ts double, id long, v double"


def accepted_by_force(rows, gap):
    out, last = [], {}
    for k, ts, i, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if k not in last or ts - last[k] >= gap:
            last[k] = ts
            out.append((k, ts, i))
    return out


@pytest.mark.parametrize("seed, gap, run_rows", [(1, 10.0, 1024), (2, 10.0, 4), (3, 3.0, 1), (4, 500.0, 1)])
def test_rate_limit_by_arrays_and_by_pointers(spark, seed, gap, run_rows):
    rows = history(seed)
    got = sequence.rate_limited(spark.createDataFrame(rows, SCHEMA), "k", "ts", "id", gap, run_rows)
    assert sorted(tuple(r) for r in got.collect()) == accepted_by_force(rows, gap)
    if run_rows == 1024:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "MapInPandas" not in plan and "ArrowEvalPython" not in plan


def test_one_dense_key_needs_log_many_rounds(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(lineage, "cut", lambda d, real=lineage.cut: cuts.append(1) or real(d))
    rows = [("hot", float(i), i, None) for i in range(3000)]
    got = sequence.rate_limited(spark.createDataFrame(rows, SCHEMA), "k", "ts", "id", 5.0, 100)
    assert sorted(r["id"] for r in got.collect()) == list(range(0, 3000, 5)) and len(cuts) <= 2 * 12


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_medians_are_exact(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [(f"k{j}", rng.choice([None, 1.0, rng.gauss(0, 1e6), float(rng.randint(0, 5))])) for j in range(12) for _ in range(rng.choice([1, 2, 3, 40, 900]))] + [("null", None)] * 3 + [(None, 4.0), (None, 6.0)] + [("same", 7.0)] * 500
    got = {r["k"]: r["median"] for r in ranks.medians(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v", accuracy=accuracy).collect()}
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    assert got == {k: statistics.median(vs) if (vs := [v for v in values if v is not None]) else None for k, values in want.items()}


def test_places_equal_a_sort(spark):
    rows = history(9)
    got = ranks.with_place(spark.createDataFrame(rows, SCHEMA), ["k"], ["ts", "id"], 7.0, "_i", "_n").collect()
    for k in "abc":
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: (r["ts"], r["id"]))
        assert [r["_i"] for r in mine] == list(range(1, len(mine) + 1)) and {r["_n"] for r in mine} == {len(mine)}


def test_error_runs_and_nth_rows(spark):
    rows = [(k, ts, i, v) for k, ts, i, v in history(12)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r["id"] for r in sequence.error_runs(d, ["k"], ["ts", "id"], F.col("v") < 50, 3, 11.0).collect()}
    nth = {r["id"] for r in sequence.every_nth(d, ["k"], ["ts", "id"], 4, 11.0).collect()}
    want, want_nth = set(), set()
    for k in "abc":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])
        want |= {mine[i][2] for i in range(2, len(mine)) if all(x[3] is not None and x[3] < 50 for x in mine[i - 2 : i + 1])}
        want_nth |= {r[2] for r in mine[::4]}
    assert got == want and nth == want_nth and want


def test_unsuppressed_needs_no_sort_of_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), float(t), t, rng.randint(1, 4)) for t in range(300)]
    got = sorted(r["id"] for r in signals.unsuppressed(spark.createDataFrame(rows, "k string, ts double, id long, rank int"), ["k"], ["ts", "id"], "rank").collect())
    best, want = {}, []
    for k, _, i, rank in rows:
        if rank > best.get(k, 0):
            best[k] = rank
            want.append(i)
    assert got == want


def test_occurrences_over_stretches(spark):
    rows = [("f", float(i), "xxyyyxz"[i % 7]) for i in range(100)]
    want = 1 + sum(a[2] != b[2] for a, b in zip(rows, rows[1:]))
    assert errors.occurrences(spark.createDataFrame(rows, "fp string, ts double, text string"), "fp", ["ts"], "text", 9.0).first()["occurrences"] == want


def test_files_of_one_name_do_not_meet(spark):
    code = spark.range(2000).select(F.concat(F.lit("/repo/pkg"), F.col("id").cast("string"), F.lit("/index.js")).alias("path"), F.lit(3).alias("line_no"), F.col("id").cast("string").alias("text"))
    frames = spark.createDataFrame([(1, "pkg7/index.js", 3), (2, "index.js", 3), (3, "C:\\build\\repo\\pkg9\\index.js", 4), (4, "./pkg11/index.js", 5), (5, "none.js", 1), (6, None, 1), (7, "g7/index.js", 3)], "id int, file string, line int")
    got = {r["file"]: (r["path"], r["length"], r["candidates"]) for r in exceptions.resolved_files(frames, code).collect()}
    assert got == {"pkg7/index.js": ("/repo/pkg7/index.js", 2, 1), "index.js": ("/repo/pkg0/index.js", 1, 2000), "C:\\build\\repo\\pkg9\\index.js": ("/repo/pkg9/index.js", 3, 1), "./pkg11/index.js": ("/repo/pkg11/index.js", 2, 1)}
    lines = {(r["id"], r["path"], r["text"]) for r in exceptions.source_lines(frames, code, 2).collect()}
    assert lines == {(1, "/repo/pkg7/index.js", "7"), (2, "/repo/pkg0/index.js", "0"), (3, "/repo/pkg9/index.js", "9"), (4, "/repo/pkg11/index.js", "11")}


def test_lines_of_code_do_not_pass_the_driver(spark):
    physical = catalogue.queries()["frames_in_code"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in physical and "BroadcastHashJoin" not in physical


def test_formats_of_sources_by_their_first_line(spark, monkeypatch):
    log4j, npm, pairs = "2024-01-05 10:00:00 [main] WARN app.Svc - event 1", "npm ERR! x", 'level=warn ts=2024-01-05T10:00:00Z msg="x" k=1'
    sources = {"one": [log4j] * 3, "first": [npm] + [log4j] * 4, "last": [log4j] * 4 + [npm], "tie": [npm, log4j], "json": ['{"ts": 1}'] * 3, "bad": ['{"ts": 1}', "{", "x"], "pairs": [pairs] * 3, "stamps": ["2024-01-05 10:00:00 ~ x"] * 3, "text": ["x"], "late": [log4j] * 60 + [npm] * 80, None: [npm] * 2}
    lines = spark.createDataFrame([(s, n, x) for s, xs in sources.items() for n, x in enumerate(["", *xs])], "src string, no int, line string")
    plain = {}
    for r in parsing.scores(lines.filter("no <= 60"), "src", "line").collect():
        plain[r["source"]] = min(plain.get(r["source"], (0.0, 0, "")), (-r["score"], r["priority"], r["adapter"]))
    runs = []
    monkeypatch.setattr(lineage, "cut", lambda d, real=lineage.cut: runs.append(real(d)) or runs[-1])
    read = parsing.recognised(lines, "src", "line", ["no"])
    assert {r["source"]: (r["adapter"], r["score"]) for r in runs[0].collect()} == {s: (name, round(-less, 6)) for s, (less, _, name) in plain.items()}
    # detection runs once, and neither more of it nor of the parsing is left in the plan
    physical = read._jdf.queryExecution().executedPlan().toString()
    assert len(runs) == 1 and "Window" not in physical and "regexp_extract" not in physical
    same = lambda d: sorted((str(r["src"]), r["no"], r["adapter"]) for r in d.collect())
    assert same(read) == same(parsing.parse(lines, runs[0], "src", "line")) == same(parsing.normalised(lines, "src", "line", ["no"])) and len(runs) == 2


def test_coverage_does_not_parse(spark):
    for name in ("source_coverage", "coverage_verdicts"):
        physical = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "RLIKE" in physical and "regexp_extract" not in physical


def test_fields_of_a_json_line_are_read_once(spark):
    lines = spark.createDataFrame([('{"ts": 1700000000, "level": 50, "msg": "x", "k": 1}',), ('{"ts_ms": 1, "category": "error", "data": {"message": "m", "level": "fatal"}}',), ("{}",), ("{",), ("x",), (None,)], "line string")
    read = lines.select(formats.json_line(F.col("line")).alias("e"))
    assert read._jdf.queryExecution().analyzed().toString().count("from_json(MapType(StringType,StringType,true), line#") == 1
    got = [r["e"] and (r["e"]["ts_text"], r["e"]["level"], r["e"]["source"], r["e"]["message"], r["e"]["data"]) for r in read.collect()]
    assert got == [("1700000000", "ERROR", "jsonl", "x", {"k": "1"}), ("1", "FATAL", "jsonl", "m", {"message": "m", "level": "fatal"}), (None, "", "jsonl", "", {}), None, None, None]


def test_stamps_are_read_by_place(spark):
    stamps = {"2024-02-29 10:11:12.5": 1709201472500.0, "2023-02-29 10:11:12": None, "2024/02/29 00:00:00": 1709164800000.0, "2024-02-29T10:11:12+01:00": 1709197872000.0, "2024-13-01 00:00:00": None, "2024-01-01 24:00:00": None, "10:11": None}
    read = spark.createDataFrame([(x,) for x in stamps], "x string").select("x", timeparse.parse_timestamp(F.col("x")).alias("ms"))
    assert {r["x"]: r["ms"] for r in read.collect()} == stamps
    assert "try_to_date" not in (shown := read._jdf.queryExecution().optimizedPlan().toString()) and "format_string" not in shown


def test_records_across_stretches(spark):
    rng = random.Random(5)
    lines, want, no = [], [], 0
    for name in ("a", "b"):
        record = None
        for n in range(200):
            starts = rng.random() < 0.2
            line = f"# {n}" if starts else f" more {n}"
            lines.append((name, n, line))
            if starts:
                record = [n, [line]]
                want.append((name, record))
            elif record:
                record[1].append(line)
    got = records.assembled(spark.createDataFrame(lines, "f string, no long, line string"), ["f"], "no", "line", F.col("line").startswith("#"), 7).filter("record_no > 0").collect()
    assert sorted((r["f"], r["first"], r["record"]) for r in got) == sorted((f, first, "\n".join(some)) for f, (first, some) in want)


@pytest.mark.parametrize(
    "pattern, words",
    [("fail(ed|ure)? now", {"fail"}), ("a|b", None), ("ab|cd", {"ab", "cd"}), (r"\bdisk\s+full\b", {"disk"}), ("(?:foo|barbaz)+qu", {"foo", "barbaz"}), ("x*", None), (r"\d+", None), ("(abc)?d*", None), ("Straße", {"strasse"}), ("^# Time:", {"# time:"}), ("ab{2,3}c", {"a"}), ("(?=zz)long word", {"long word"})],
)
def test_words_that_a_pattern_needs(pattern, words):
    got = predicates.needed_words(pattern)
    assert (set(got) if got else None) == words


def test_patterns_run_only_where_their_words_are():
    table = predicates.Patterns(["timeout after", r"\d+ errors", "[unclosed", "disk"])
    assert table.counts("Timeout after 3 and TIMEOUT AFTER 4 [unclosed DISK") == {0: 2, 2: 1, 3: 1} and table.runs == 3
    assert table.counts("nothing here") == {} and table.runs == 3
    assert table.counts("12 errors") == {1: 1}


def test_a_thousand_watches_in_one_scan(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    watches = [(f"w{i}", rng.choice(["", "error", None]), rng.choice([None, "WARN"]), rng.choice([None, "", "s1"]), rng.choice([f"{rng.choice(words)} {rng.choice(words)}", rf"\b{rng.choice(words)}\b", f"({rng.choice(words)}|{rng.choice(words)}) x", ""])) for i in range(1000)]
    events = [(i, float(i), rng.choice(["error", "info"]), rng.choice(["WARN", "INFO"]), rng.choice(["s1", "s2"]), rng.choice([None, " ".join(rng.choice([*words, "x", "X"]) for _ in range(30))])) for i in range(120)]
    import re

    want = set()
    for i, _, category, level, source, props in events:
        for name, c, le, s, rx in watches:
            if (not c or c == category) and (not le or le == level) and (not s or s == source) and (not rx or (props is not None and re.search(rx, props, re.I))):
                want.add((i, name))
    e = spark.createDataFrame(events, "event_id long, ts_ms double, category string, level string, source string, props string")
    w = spark.createDataFrame(watches, "name string, category string, level string, source string, regex string")
    found = predicates.watch_hits(e, w, ["event_id", "ts_ms"])
    got = [(r["event_id"], r["watch"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1
    with pytest.raises(ValueError):
        predicates.collected(w, ["name"], 999)


def test_watches_on_a_stream_accumulate(spark, tmp_path):
    schema = "event_id long, ts_ms double, category string, level string, source string, props string"
    watches = spark.createDataFrame([("e", "error", "", "", ""), ("d", "", "", "", "disk (?:full|gone)")], "name string, category string, level string, source string, regex string")
    folder, seen = str(tmp_path / "in"), []
    for batch in ([(1, 1.0, "error", "INFO", "s", "a"), (2, 2.0, "info", "INFO", "s", "Disk Full")], [(3, 3.0, "error", "INFO", "s", "disk gone")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        totals = predicates.watch_totals(predicates.watch_hits(stream.read_parquet(spark, folder, schema), watches, ["event_id", "ts_ms"]))
        query = totals.writeStream.outputMode("update").foreachBatch(lambda d, i: seen.append(sorted(tuple(r) for r in d.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    seen = [s for s in seen if s]
    assert seen == [[("d", 1, 2.0, 2.0), ("e", 1, 1.0, 1.0)], [("d", 2, 2.0, 3.0), ("e", 2, 1.0, 3.0)]]


def test_every_code_signal_has_words_and_finds_code(spark):
    assert len(codesigns.SIGNALS) == 71 and all(predicates.needed_words(p) for p in codesigns.SIGNALS.values())
    code = "import logging\nimport threading\n\nasync def f():\n    try:\n        await g()\n    except ValueError: pass\n\nif __name__ == '__main__':\n    asyncio.run(f())\n"
    got = {r["signal"]: (r["hits"], r["files"], r["example"]) for r in predicates.signal_report(spark.createDataFrame([("a.py", code), ("b.py", "x = 1"), ("c.py", None)], "path string, text string"), "path", "text", codesigns.SIGNALS).collect()}
    assert {"async", "existing_logging", "py_stdlib_logging", "exception_handlers", "discards_error", "launch_surface", "event_loop_runner"} <= set(got) and got["async"] == (3, 1, "a.py")


def test_plans_for_small_and_large_keys_agree(spark, monkeypatch):
    from tidelog.operators import hardware

    rng = random.Random(4)
    rows = spark.createDataFrame(history(21), SCHEMA).filter("v IS NOT NULL")
    samples = spark.createDataFrame([(k, float(t), 60 + rng.random() * 45, "cpu", rng.choice([0, 900]), rng.choice([11.0, 11.9, 12.1]), rng.random() * 300) for k in "abc" for t in range(0, 900, 7)], "k string, ts_s double, temp double, temp_label string, fan_rpm int, volts double, watts double")
    shown = lambda d: sorted(map(str, d.collect()))
    ways = []
    for small in (True, False):
        monkeypatch.setattr(ranks, "bounded", lambda *a, small=small: small)
        ways.append([shown(sequence.sag(rows, ["k"], ["ts", "id"], "v", 50.0)), shown(sequence.spikes(rows, ["k"], ["ts", "id"], "v", 0.5)), shown(hardware.telemetry_points(samples, ["k"], 60.0))])
    assert ways[0] == ways[1] and all(ways[0])
