"""Stateful processors: against the batch operators, a plain memory, and the clock; across restarts."""

import json
import random
import time
from collections import OrderedDict

from pyspark.sql import functions as F

from tidelog.operators import signals
from tidelog.streaming import processors, stream

EVENT = "ts timestamp, key string, kind string, n int"


def put(spark, folder, rows, schema):
    """One more file, so one more batch."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def step(source, out, checkpoint):
    query = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_recorder_equals_batch_incidents(spark, tmp_path):
    rng = random.Random(8)
    t0, rows = 1_700_000_000, []
    for key in ("a", "b"):
        at = t0
        for n in range(260):
            at += rng.choice([1, 2, 5, 20, 61, 90])
            rows.append((at, key, "error" if rng.random() < 0.12 else "info", n))
    rows.sort()
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    end = rows[-1][0] + 1000
    for i in range(0, len(rows), 90):  # each step is a new run of the query
        batch = rows[i : i + 90]
        rng.shuffle(batch)
        spark.createDataFrame(batch, "s long, key string, kind string, n int").select(F.timestamp_seconds("s").alias("ts"), "key", "kind", "n").coalesce(2).write.mode("append").parquet(folder)
        if i + 90 >= len(rows):
            for extra in range(3):  # time goes on for all keys
                spark.createDataFrame([(end + 500 * extra, k, "info", -1) for k in "ab"], "s long, key string, kind string, n int").select(F.timestamp_seconds("s").alias("ts"), "key", "kind", "n").coalesce(1).write.mode("append").parquet(folder)
                run_recorder(spark, folder, out, checkpoint)
        else:
            run_recorder(spark, folder, out, checkpoint)
    got = spark.read.parquet(out).collect()
    events = spark.createDataFrame([(k, s * 1000.0, kind, n) for s, k, kind, n in rows], "key string, ts_ms double, kind string, n int")
    want = signals.incidents(events.filter("kind = 'error'"), "ts_ms", ["key"]).collect()
    assert {(r["key"], r["from_ms"], r["to_ms"], r["triggers"]) for r in got} == {(r["key"], r["from_ms"], r["to_ms"], r["triggers"]) for r in want} and len(want) > 5
    inside = sorted((w["key"], w["from_ms"], s * 1000.0, n) for w in want for s, k, _, n in rows if k == w["key"] and w["from_ms"] <= s * 1000.0 <= w["to_ms"])
    assert sorted((r["key"], r["from_ms"], r["ts_ms"], json.loads(r["event"])["n"]) for r in got) == inside  # each event once
    assert any(w["triggers"] > 1 for w in want)


def run_recorder(spark, folder, out, checkpoint):
    source = stream.read_parquet(spark, folder, EVENT).withWatermark("ts", "0 seconds")
    step(processors.incidents(source, "key", "ts", F.col("kind") == "error", ["kind", "n"]), out, checkpoint)


def test_memory_equals_an_ordered_dict_across_restarts(spark, tmp_path):
    rng, plain, want = random.Random(3), OrderedDict(), []
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema, ts = "scope string, session string, fp string, rank int, ts_ms double", 0
    for _ in range(4):
        rows = []
        for _ in range(250):
            ts += 1
            row = ("s", f"u{int(rng.expovariate(0.25))}", f"f{rng.randrange(12)}", rng.randint(1, 3), float(ts))
            rows.append(row)
            known = plain.pop(row[1], OrderedDict())
            plain[row[1]] = known
            while len(plain) > 5:
                del plain[next(iter(plain))]
            before = known.pop(row[2], 0)
            known[row[2]] = max(before, row[3])
            while len(known) > 7:
                del known[next(iter(known))]
            if row[3] > before:
                want.append(row)
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(folder)
        step(processors.surfaced(stream.read_parquet(spark, folder, schema), 5, 7), out, checkpoint)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == sorted(want)


STATE = "session string, ts_ms double, running boolean, new_errors array<string>, recurring_errors array<string>, stuck boolean, anomaly boolean, blank boolean, expiring int, awaiting int, cleared_errors array<string>, started boolean, tracked array<string>"


def test_decisions_over_ticks_equal_the_batch_operators(spark, tmp_path):
    rng = random.Random(6)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    said_schema = "session string, kind string, fp string, rank int, at_s double"
    said, taken_back, want = [], set(), []
    for tick in range(5):
        at_s = 1000.0 + 30 * tick
        flip = lambda p: rng.random() < p
        rows = [(f"s{i}", at_s * 1000, not flip(0.2), [f"e{rng.randrange(3)}"] * flip(0.5), ["old"] * flip(0.3), flip(0.4), flip(0.3), flip(0.3), int(flip(0.4)), int(flip(0.5)), [], tick == 0, [f"e{rng.randrange(3)}"]) for i in range(6)]
        put(spark, folder, rows, STATE)
        ticks = lambda d: d.select("session", "ts_ms", signals.listed().alias("signals"), "tracked")
        step(processors.decisions(ticks(stream.read_parquet(spark, folder, STATE))), out, checkpoint)
        # the same moment by the batch operators
        state = spark.createDataFrame(rows, STATE)
        live = signals.built(state, ["session"])
        claims = spark.createDataFrame([x[:3] for x in said if x[3] >= 2 and x[:3] not in taken_back], "session string, kind string, fp string")
        tracked = {(r[0], fp) for r in rows for fp in r[12]}
        gone = signals.retractions(claims.limit(0), live, claims, ["session", "kind", "fp"])
        back = [(r["session"], r["kind"], "notice", r["fp"], True, False, 2, "") for r in gone.collect() if (r["session"], r["fp"]) not in tracked]
        pool = live.withColumn("correction", F.lit(False)).unionByName(spark.createDataFrame(back, "session string, kind string, tier string, fp string, correction boolean, deadline boolean, rank int, identity string"))
        spoken = spark.createDataFrame([x for x in said], said_schema).unionByName(spark.createDataFrame([(s, "", "", r, a) for s, r, a in {(x[0], 2, x[4]) for x in want_said(want)}], said_schema))
        new = signals.decided(pool, spoken, ["session"], at_s).select("session", "kind", "fp", "rank", "correction", "tier").collect()
        want += [(r["session"], at_s, r["tier"], r["kind"], r["fp"], r["correction"]) for r in new]
        taken_back |= {(r["session"], r["kind"], r["fp"]) for r in new if r["correction"]}
        said += [(r["session"], r["kind"], r["fp"], r["rank"], at_s) for r in new if not r["correction"]]
    got = [tuple(r) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(want) and any(r[5] for r in got) and len(got) > 15
    once = [(r[0], r[3], r[4]) for r in got if r[5]]
    assert len(once) == len(set(once))


def want_said(want):
    """Corrections speak as notices."""
    return [(s, kind, fp, 2, at) for s, at, _, kind, fp, correction in want if correction]


def test_hold_runs_out_without_input(spark, tmp_path):
    folder = str(tmp_path / "in")
    put(spark, folder, [("a", False), ("b", False)], "record string, examined boolean")
    source = stream.read_parquet(spark, folder, "record string, examined boolean")
    query = processors.holds(source, 4000).writeStream.format("memory").queryName("holds").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not query.recentProgress:
            time.sleep(0.2)
        put(spark, folder, [("b", True)], "record string, examined boolean")
        while time.time() < until and spark.table("holds").count() < 2:
            time.sleep(0.5)
    finally:
        query.stop()
    got = {r["record"]: (r["outcome"], r["held_ms"]) for r in spark.table("holds").collect()}
    assert got["a"][0] == "expired" and got["a"][1] >= 4000 and got["b"][0] == "examined"


def test_a_keys_rows_are_sorted_across_arrow_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        put(spark, folder, [("s", f"f{i}", 3, float(t)) for i, t in enumerate([40_000, 30_000, 20_000, 10_000, 0, 5_000])], "session string, fp string, tier int, ts_ms double")
        stream.run_once(stream.rate_limited(stream.read_parquet(spark, folder, "session string, fp string, tier int, ts_ms double")), "ordered", str(tmp_path / "cp"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["ts_ms"] for r in spark.table("ordered").collect()) == [0.0, 10_000.0, 20_000.0, 30_000.0, 40_000.0]


def test_console_locks_on_its_first_known_format(spark, tmp_path):
    schema, folder = "channel string, line string, arrived timestamp", str(tmp_path / "in")
    places = [str(tmp_path / x) for x in ("sink", "locks", "cp")]
    log4j = "2024-01-05 10:00:0{0},123 [main] WARN app.Svc - event {0}"

    def step(rows):
        spark.createDataFrame(rows, "channel string, line string").withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000))).coalesce(1).write.mode("append").parquet(folder)
        stream.console_tee(stream.read_parquet(spark, folder, schema), *places).awaitTermination()
        return {(r["channel"], r["adapter"]) for r in stream.known_locks(spark, places[1]).collect()}

    assert step([("stdout", "starting up"), ("stderr", "oops")]) == set()
    assert step([("stdout", log4j.format(i)) for i in range(4)]) == {("stdout", "log4j")}
    assert step([("stdout", "plain again"), ("stdout", log4j.format(9)), ("stderr", "half done")]) == {("stdout", "log4j")}
    rows = {r["message"]: r for r in spark.read.json(places[0]).collect()}
    assert len(rows) == 9 and rows["event 9"]["level"] == "WARN" and rows["event 9"]["emit_ts_ms"] == 1704448809123.0
    assert rows["oops"]["level"] == "ERROR" and rows["oops"]["category"] == "error" and rows["plain again"]["level"] == "INFO"


def test_baselines_are_kept(spark, tmp_path):
    path = str(tmp_path / "baselines")
    assert signals.load_baselines(spark, path).count() == 0
    for key, ms in (("a", 5.0), ("b", 7.0), ("a", 9.0)):
        signals.save_baseline(spark, path, key, ms)
    kept = signals.load_baselines(spark, path)
    assert {tuple(r) for r in kept.collect()} == {("a", 9.0), ("b", 7.0)}
    events = spark.createDataFrame([("a", 8.0), ("a", 9.0), ("b", 6.0), ("c", 1.0)], "key string, ts_ms double")
    assert {tuple(r) for r in signals.since_baseline(events, kept, ["key"], "ts_ms").collect()} == {("a", 9.0), ("c", 1.0)}


def test_alerts_that_follow_within_the_gap_are_one(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 0), ("a", 100), ("a", 1000), ("b", 50), ("z", 100_000)], "kind string, s long").select("kind", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(folder)
    spark.createDataFrame([("z", 200_000)], "kind string, s long").select("kind", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    source = stream.read_parquet(spark, folder, "kind string, ts timestamp", 1).withWatermark("ts", "0 seconds")
    stream.run_once(stream.gap_sessions(source, "kind"), "gaps", str(tmp_path / "cp"))
    assert {(r["kind"], r["n"]) for r in spark.table("gaps").filter("kind <> 'z'").collect()} == {("a", 2), ("a", 1), ("b", 1)}
