"""Sources, sinks, plans and streams that the catalogue's SQL cannot reach."""

import pytest
from pyspark.sql import functions as F

from tidelog.functions import formats, text
from tidelog.operators import composites, errors, parsing, sequence, state, timeline
from tidelog.plans import catalogue
from tidelog.sources import sinks
from tidelog.sources import text as sources
from tidelog.streaming import stream

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_lines_keep_their_numbers_when_files_are_split(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) if i % 7 else "" for i in range(20_000)]
    (tmp_path / "a.log").write_text("\n".join(lines))
    (tmp_path / "b.log").write_text("one\r\ntwo\n\nfour")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = parsing.read_lines(spark, str(tmp_path), "lab", "*.log")
        got = {(r["log_path"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in read.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.log", i): x for i, x in enumerate(lines) if x} | {("b.log", 0): "one", ("b.log", 1): "two", ("b.log", 3): "four"}


def test_parse_reads_its_input_once(spark):
    rows = [("a", 0, "hello"), ("b", 0, "npm ERR! x"), ("c", 0, "src/a.c:3:4: warning: u")]
    spark.createDataFrame(rows, "src string, no int, line string").createOrReplaceTempView("parsed_input")
    lines = spark.table("parsed_input")
    found = parsing.detect(lines, "src", "line", ["no"])
    physical = plan(parsing.parse(lines, spark.createDataFrame(found.collect(), found.schema), "src", "line")).split("== Physical Plan ==")[1]
    assert physical.count("Scan ExistingRDD[src") == 1 and "Union" not in physical


def test_time_filter_reaches_the_scan(spark):
    assert "PushedFilters: [Or(IsNull(ts)" in plan(catalogue.timeline_window(spark, SF)).replace("[or", "[Or")


def test_fingerprint_is_worked_out_once(spark):
    physical = plan(catalogue.errors_by_fingerprint(spark, SF)).split("== Physical Plan ==")[1]
    assert physical.count("sha1(") == 1


def test_roles_never_scans_once(spark):
    assert plan(catalogue.roles_never(spark, SF)).split("== Physical Plan ==")[1].count("Scan parquet") == 1


def test_flatten_in_one_scan_with_bounds(spark):
    big = "{" + ", ".join(f'"k{i:03}": {i}' for i in range(500)) + "}"
    deep = '{"a": {"a": {"a": {"a": {"a": {"a": {"a": 1}}}}}}}'
    rows = spark.createDataFrame([(1, big), (2, deep), (3, "[1, {\"x\": [2]}]"), (4, "5"), (5, "no"), (6, None), (7, "{}"), (8, '{"l": [' + ", ".join(map(str, range(150))) + "]}")], "id int, j string")
    flat = state.flatten(rows, ["id"], "j")
    assert plan(flat).split("== Physical Plan ==")[1].count("Scan") == 1
    got = {}
    for r in flat.collect():
        got.setdefault(r["id"], {})[r["path"]] = r["value"]
    assert len(got[1]) == 400 and got[2] == {"a.a.a.a.a.a": '{"a":1}'} and got[3] == {"[0]": "1", "[1].x[0]": "2"}
    assert set(got) == {1, 2, 3, 8} and len(got[8]) == 100


def test_stretches_give_the_same_runs(spark):
    e = catalogue.events(spark, SF)
    key = lambda rows: sorted(tuple(r) for r in rows.collect())
    for width in (3_600_000, 10 * catalogue.DAY):
        assert key(sequence.run_lengths(e, ["source"], ["ts_ms", "event_id"], "category", width)) == key(sequence.run_lengths(e, ["source"], ["ts_ms", "event_id"], "category"))
        assert key(sequence.sessions(e, ["source"], "ts_ms", 3_600_000, "event_id", width=width)) == key(sequence.sessions(e, ["source"], "ts_ms", 3_600_000, "event_id"))
        d = lambda w: key(sequence.deltas(e, ["source"], ["ts_ms", "event_id"], "value", w).select("event_id", "delta").na.fill(-1))
        assert d(width) == d(None)
    blanks = spark.createDataFrame([("a", 0, None), ("a", 5, None), ("a", 11, "x"), ("a", 25, "x"), ("b", 3, None)], "k string, n int, v string")
    assert key(sequence.run_lengths(blanks, ["k"], ["n"], "v", 10).na.fill("-")) == key(sequence.run_lengths(blanks, ["k"], ["n"], "v").na.fill("-"))


def test_formats_can_be_added_tested_and_listed(spark):
    found = parsing.add_format({}, "mine", r"^%%(?<level>\w+)%%(?<msg>.*)$", ["%%WARN%%a", "%%INFO%%b"], spark)
    assert list(found) == ["mine"]
    with pytest.raises(ValueError, match="built-in"):
        parsing.add_format({}, "npm", "x", ["x"], spark)
    with pytest.raises(ValueError, match="fits 1 of 2"):
        parsing.add_format({}, "mine", "^a$", ["a", "b"], spark)
    with pytest.raises(ValueError, match="read 1 of the sample"):
        parsing.add_format({}, "mine", "^(?:npm|zzz).*$", ["npm ERR! x", "zzz"], spark)
    assert parsing.test_line(spark, "npm ERR! code 1").first()["adapter"] == "npm"
    table = parsing.format_table(spark)
    assert table.count() == len(formats.FORMATS) > 250 and table.filter("family = 'kernel'").count() == parsing.format_table(spark, "kernel").count() > 5
    assert [r["name"] for r in parsing.format_table(spark, q="npm").collect()] == ["npm", "pnpm"]


def test_formats_are_kept(spark, tmp_path):
    path = str(tmp_path / "formats")
    mine = formats.Format("mine", "user", "stamp", "", r"^(?<msg>.*)$")
    assert parsing.load_formats(spark, path) == {}
    parsing.save_format(spark, path, mine)
    assert parsing.load_formats(spark, path) == {"mine": mine}
    with pytest.raises(ValueError, match="already"):
        parsing.save_format(spark, path, mine)
    with pytest.raises(ValueError, match="already"):
        parsing.save_format(spark, path, formats.FORMATS["npm"])


def test_multi_line_scores(spark):
    row = spark.createDataFrame([("a1\nb\na2",), ("b\nb\na",), ("a\\na\\nb",), ("",)], "t string")
    hit = lambda x: x.startswith("a")
    got = [tuple(r) for r in row.select(parsing.multiline_score(F.col("t"), hit), parsing.multiline_score(F.col("t"), hit, literal=True), parsing.capped_score(F.lit(0.97))).collect()]
    assert got == [(1.0, 1.0, 0.85), (0.0, 0.0, 0.85), (1.0, 1.0, 0.85), (0.0, 0.0, 0.85)]


def test_tables_of_sources(spark):
    explicit = spark.createDataFrame([(1, "/a/./x.log", "x", "npm"), (2, "/b.log", "b", None)], "priority int, path string, label string, adapter string")
    legacy = spark.createDataFrame([(1, "/a/x.log", "old", None), (2, "/c.log", "c", None)], "priority int, path string, label string, adapter string")
    assert [(r["path"], r["label"]) for r in sources.sources(explicit, legacy).collect()] == [("/a/x.log", "x"), ("/b.log", "b"), ("/c.log", "c")]
    profile = spark.createDataFrame([("p", 2, "source", "a", "/x.jsonl"), ("p", 1, "sink", "events", "/e.jsonl"), ("p", 0, "legacy", "", ""), ("q", 3, "source", "z", "/z.jsonl"), ("r", 1, "source", "t", "/t.log")], "name string, priority int, kind string, label string, path string")
    assert {r["name"]: r["path"] for r in sources.action_log(profile).collect()} == {"p": "/e.jsonl", "q": "/z.jsonl"}


def test_tails_and_deltas(spark):
    lines = spark.createDataFrame([("f", i, '{"a": %d}' % i if i % 2 else "broken {", i * 10, 200, 1000.0) for i in range(20)], "path string, n int, line string, offset long, size long, modified_ms double")
    assert [r["n"] for r in sources.last_lines(lines, ["path"], "n", 3).orderBy("n").collect()] == [17, 18, 19]
    assert [r["n"] for r in sources.last_records(lines, ["path"], "n", "line", 3).orderBy("n").collect()] == [15, 17, 19]
    saved = lambda n: spark.createDataFrame([("f", n)], "path string, saved long")
    delta = lambda n, **o: sources.raw_delta(lines, saved(n), "path", "offset", "size", "modified_ms", 200_000.0, **o)
    assert delta(150).count() == 5 and delta(500).count() == 20 and delta(500).first()["restarted"] and delta(0, most=50).count() == 5
    assert delta(150).first()["stale"]
    status = sources.file_status(lines.withColumn("ts", F.lit(1000.0)), "path", "ts", 200_000.0).first()
    assert status["lines"] == 20 and status["stale"]


def test_project_languages(spark):
    listing = lambda *names: spark.createDataFrame([(f"/p/{n}", 10, sources.LANGUAGES.get(n.rsplit(".", 1)[-1])) for n in names], "path string, length long, language string")
    of = lambda *names: tuple(sources.project_language(listing(*names)).first())
    assert of("a.py", "b.py", "go.mod") == ("go", "strong marker") and of("a.py", "b.rs", "c.rs") == ("rust", "census") and of("Makefile", "x.bin") == ("c", "weak marker")


def test_sinks(spark, tmp_path):
    d = str(tmp_path)
    rows = spark.createDataFrame([(float(86_400 * day + s), s) for day in range(3) for s in range(5)], "ts double, v int")
    sinks.write_samples(rows, f"{d}/samples")
    assert sinks.read_recent(spark, f"{d}/samples", 2.0, "ts double, v int").count() == 3
    assert len(sinks.within_budget(spark, f"{d}/samples", 1)) == 2
    assert spark.read.json(f"{d}/samples").count() == 5
    files = spark.createDataFrame([("a", 10, "1"), ("b", 10, "2"), ("c", 10, "3")], "path string, length long, day string")
    assert [r["path"] for r in sinks.over_budget(files, 20).collect()] == ["a"]
    rows.write.parquet(f"{d}/original")
    assert sinks.archive_and_delete(spark.read.parquet(f"{d}/original"), f"{d}/archive", 1, f"{d}/original") == 15
    assert not (tmp_path / "original").exists() and spark.read.parquet(f"{d}/archive/version=000001").count() == 15
    sinks.freeze(rows, spark.createDataFrame([("thermal", 3.0)], "cause string, score double"), f"{d}/capsules", "ts", 2.0)
    assert sinks.capsules(spark, f"{d}/capsules").count() == 4
    frames = spark.createDataFrame([(7,)], "sequence long")
    sinks.write_frames(frames, f"{d}/frames")
    sinks.append_frame_note(spark, f"{d}/notes", frames, 7, "odd")
    with pytest.raises(ValueError, match="no frame 8"):
        sinks.append_frame_note(spark, f"{d}/notes", frames, 8, "odd")
    assert [(r["key"], r["message"]) for r in spark.read.parquet(f"{d}/notes").collect()] == [("frame/7", "odd")]


def test_replay_of_changes(spark):
    frames = spark.createDataFrame([("s", i * 10, i) for i in range(8)], "source string, ts_ms long, n int")
    logs = spark.createDataFrame([("s", t) for t in (1, 2, 15, 33, 69)], "source string, r_ts_ms long")
    got = {r["n"]: (r["changed_moment"], r["log_rows"]) for r in composites.replay(frames, ["source"], ["ts_ms"], F.col("n") == 4, logs, 3).collect()}
    assert got == {0: (False, 0), 3: (False, 3), 4: (True, 1), 6: (False, 0)}


def test_search_takes_filters(spark):
    rows = spark.createDataFrame([("a [x", "ERROR", "error", "t1"), ("a [x", "INFO", "log", "t1"), ("b", "ERROR", "error", "t2")], "m string, level string, category string, trace_id string")
    assert timeline.search(rows, "m", "[x", regex=True, level="WARN").count() == 1
    assert timeline.search(rows, "m", "", trace_id="t1").count() == 2 and timeline.search(rows, "m", "A", category="log").count() == 1
    assert errors.of_fingerprint(rows.withColumn("m", F.lit("disk 5")), "m", spark.range(1).select(text.fingerprint(F.lit("disk 7"))).first()[0]).count() == 3


def test_streams_of_lines_alerts_and_triggers(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("2024-01-01 00:00:00 ok\nboom error\n")
    lines = stream.read_lines(spark, str(tmp_path / "logs"))
    console = stream.console_events(lines.withColumn("arrived", F.current_timestamp()), "stderr")
    stream.run_once(console, "console", str(tmp_path / "c1"))
    got = {r["message"]: (r["level"], r["emit_ts_ms"]) for r in spark.table("console").collect()}
    assert got == {"2024-01-01 00:00:00 ok": ("ERROR", 1704067200000.0), "boom error": ("ERROR", None)}
    (tmp_path / "logs" / "b.log").write_text("later\n")  # the next run takes the new file only
    stream.run_once(lines.select("line"), "again", str(tmp_path / "c2"))
    assert spark.table("again").count() == 3
    assert stream.wait_for(lines, F.col("line") == "later", 20, str(tmp_path / "c3"))
    samples = "ts timestamp, key string, temp double, load double"
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 30) AS ts, 'k' AS key, CAST(60.0 + id AS double) AS temp, CAST(id AS double) AS load FROM range(10)").coalesce(1).write.parquet(str(tmp_path / "s"))
    read = lambda: stream.timed(stream.read_parquet(spark, str(tmp_path / "s"), samples))
    stream.run_once(stream.live_alerts(read(), {"temp": 68.0, "load": 9.0}), "alerts", str(tmp_path / "c4"))
    assert sorted(r["kind"] for r in spark.table("alerts").collect()) == ["load", "temp", "temp"]
    triggers = read().filter("load = 4").select(F.col("ts").alias("t_ts"), F.col("key").alias("t_key"))
    stream.run_once(stream.around_triggers(triggers, read()), "ring", str(tmp_path / "c5"))
    assert sorted(r["load"] for r in spark.table("ring").collect()) == [2.0, 3.0, 4.0]


def test_entropy_of_counts_and_of_text(spark):
    from tidelog.operators import visual

    row = spark.createDataFrame([("aabb", [2.0, 2.0]), ("", []), (None, None)], "t string, h array<double>")
    assert [tuple(r) for r in row.select(visual.text_entropy(F.col("t")), visual.entropy(F.col("h"))).collect()][:2] == [(1.0, 1.0), (0.0, 0.0)]
