"""Queries over machine samples, frames, signals and ledgers, all made of the shipped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import composites, errors, hardware, health, retention, sequence, signals, visual
from .catalogue import _NOW, DAY, EV, HOUR, T0, events, query, table
from .texts import choice, choice_sql, ident

_END = T0 + 10 * DAY


def sensor_samples(spark, sf_dir) -> DataFrame:
    v = F.col("value")
    return events(spark, sf_dir).select(
        "event_id", "source", (F.col("ts_ms") / 1000.0).alias("ts_s"), F.create_map(F.lit("cpu"), v % 110, F.lit("gpu"), (v * 7) % 100).alias("temps"), (v % 100).alias("load"),
        F.create_map(F.lit("cpu"), F.round(v / 10, 3), F.lit("gpu"), F.lit(5.0)).alias("power"), F.create_map(F.lit("+12V"), 11.5 + (ident() % 10) / 10.0, F.lit("VCC3V3"), F.lit(1.0)).alias("volts"),
    )


_SAMPLES = "ss AS (SELECT event_id, source, ts_ms / 1000.0::DOUBLE AS ts_s, value % 110 AS cpu, (value * 7) % 100 AS gpu, value % 100 AS load, round(value / 10, 3) + 5.0::DOUBLE AS watts, 11.5::DOUBLE + (event_id % 10) / 10.0::DOUBLE AS v12 FROM ev)"


@query(f"WITH {EV}, {_SAMPLES} SELECT event_id, greatest(cpu, gpu) AS temp, CASE WHEN gpu >= cpu THEN 'gpu' ELSE 'cpu' END AS sensor, round(watts, 6) AS watts FROM ss")
def hottest_and_power(spark, sf_dir):
    return sensor_samples(spark, sf_dir).withColumn("h", hardware.hottest(F.col("temps"))).select("event_id", F.col("h.value").alias("temp"), F.col("h.key").alias("sensor"), F.round(hardware.total_power(F.col("power")), 6).alias("watts"))


@query(f"""WITH {EV}, {_SAMPLES}, r AS (SELECT * FROM ss WHERE ts_s > {_END / 1000 - 5 * 86400} AND ts_s <= {_END / 1000})
SELECT source, max(greatest(cpu, gpu)) AS hottest, round(max(load), 6) AS load_max, round(arg_max(load, ts_s), 6) AS load_latest, round(max(watts), 6) AS watts_max, round(arg_max(watts, ts_s), 6) AS watts_latest, count(*) AS samples FROM r GROUP BY 1""")
def hardware_metrics(spark, sf_dir):
    found = hardware.metrics(sensor_samples(spark, sf_dir), ["source"], "ts_s", _END / 1000, 5 * 86400)
    return found.select("source", "hottest", *[F.round(c, 6).alias(c) for c in ("load_max", "load_latest", "watts_max", "watts_latest")], "samples")


@query(f"""WITH {EV}, {_SAMPLES}, r AS (SELECT * FROM ss WHERE ts_s > {_END / 1000 - 5 * 86400} AND ts_s <= {_END / 1000})
SELECT source, 12.0::DOUBLE AS rail, '+12V' AS label, round(min(v12), 6) AS low, round(arg_max(v12, ts_s), 6) AS latest FROM r GROUP BY 1 UNION ALL SELECT source, 3.3::DOUBLE, 'VCC3V3', 1.0::DOUBLE, 1.0::DOUBLE FROM r GROUP BY 1""")
def rail_metrics(spark, sf_dir):
    return hardware.rail_metrics(sensor_samples(spark, sf_dir), ["source"], "ts_s", _END / 1000, 5 * 86400).select("source", "rail", "label", F.round("low", 6).alias("low"), F.round("latest", 6).alias("latest"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) WHEN 'signup' THEN user_id WHEN 'purchase' THEN 0 END AS code FROM events""")
def stop_codes(spark, sf_dir):
    """Errors name a stop code in decimals, signups in hex, purchases name 0 and the rest none."""
    kind = F.col("event_type")
    line = F.when(kind == "error", F.concat(F.lit("BugcheckCode "), F.get_json_object("props", "$.k"))).when(kind == "signup", F.concat(F.lit("Bug Check Code: 0x"), F.lower(F.hex("user_id")))).when(kind == "purchase", "BugcheckCode: 0").otherwise(F.concat(F.lit("power lost "), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", hardware.bugcheck(line).alias("code"))


_CAUSE_ROWS = ", ".join(f"({code}, '{meaning}')" for code, meaning in hardware.SHUTDOWN_CAUSES.items())


@query(f"WITH c AS (SELECT CAST(5 - CAST(json_extract(props, '$.k') AS BIGINT) AS INTEGER) AS code FROM events WHERE event_type <> 'view') SELECT c.code, count(*) AS n, coalesce(m.meaning, 'unknown') AS meaning FROM c LEFT JOIN (VALUES {_CAUSE_ROWS}) m(code, meaning) ON c.code = m.code GROUP BY ALL")
def shutdown_report(spark, sf_dir):
    """Causes of shutdowns counted, codes from 5 down by what events hold; views tell of none."""
    k = (5 - F.get_json_object("props", "$.k").cast("int")).cast("string")
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.concat(F.lit("2024-01-05 kernel: Previous shutdown cause: "), k)).otherwise(F.concat(F.lit("kernel: all well "), k)).alias("line"))
    return hardware.shutdown_causes(lines, "line").select("code", "n", "meaning")


@query("SELECT event_id, line FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'mce: [Hardware Error]: bank ' WHEN 'signup' THEN 'EDAC MC0: 1 CE ' WHEN 'purchase' THEN 'cpu throttled ' WHEN 'click' THEN 'recce of ' ELSE 'all fine ' END || json_extract_string(props, '$.k') || ' ' || value AS line FROM events) WHERE NOT starts_with(line, 'all fine') AND NOT starts_with(line, 'recce') ORDER BY event_id DESC LIMIT 80")
def hardware_lines(spark, sf_dir):
    """The last 80 lines that tell of the hardware."""
    kind = F.col("event_type")
    said = F.when(kind == "error", "mce: [Hardware Error]: bank ").when(kind == "signup", "EDAC MC0: 1 CE ").when(kind == "purchase", "cpu throttled ").when(kind == "click", "recce of ").otherwise("all fine ")
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(said, F.get_json_object("props", "$.k"), F.lit(" "), F.col("value").cast("string")).alias("line"))
    return hardware.hardware_lines(lines, "line", ["event_id"])


@query(f"""WITH {EV}, m AS (SELECT source, min(user_id) AS u FROM ev GROUP BY 1),
b AS (SELECT source, u % 3 <> 0 AS rebooted, CASE u % 4 WHEN 0 THEN 0 WHEN 1 THEN 209 ELSE NULL END AS code, u % 5 = 0 AS software, 60.0::DOUBLE + u % 40 AS t, (['normal', 'temperature', 'power loss', 'watchdog'])[u % 4 + 1] AS shutdown FROM m),
p AS (SELECT source, 'psu_power' AS cause, 2.0::DOUBLE AS points FROM b WHERE rebooted AND t < 85 AND NOT software AND coalesce(code, 0) = 0 UNION ALL SELECT source, 'driver_software', 3 FROM b WHERE code <> 0 UNION ALL SELECT source, 'psu_power', 1 FROM b WHERE rebooted AND code = 0
 UNION ALL SELECT source, 'thermal', 4 FROM b WHERE shutdown = 'temperature' UNION ALL SELECT source, 'psu_power', 3 FROM b WHERE shutdown = 'power loss' UNION ALL SELECT source, 'driver_software', 2 FROM b WHERE shutdown = 'watchdog'),
g AS (SELECT source, cause, sum(points) AS score FROM p WHERE source IN (SELECT source FROM b WHERE rebooted) GROUP BY 1, 2)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, cause) AS INTEGER) AS rank, cause, score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2.5 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def boot_verdict(spark, sf_dir):
    u = F.col("u")
    boots = events(spark, sf_dir).groupBy("source").agg(F.min("user_id").alias("u")).select(
        "source", (u % 3 != 0).alias("rebooted"), F.when(u % 4 == 0, 0).when(u % 4 == 1, 209).alias("bugcheck"), (u % 5 == 0).alias("software"), (60.0 + u % 40).alias("t_max"),
        F.element_at(F.array(*[F.lit(x) for x in ("normal", "temperature", "power loss", "watchdog")]), (u % 4 + 1).cast("int")).alias("shutdown"),
    )
    return hardware.crash_report(hardware.boot_points(boots, ["source"]), boots, ["source"]).select("source", "rank", "cause", "score", "confidence")


@query(f"""WITH {EV}, r AS (SELECT source, event_id, ts_ms, category, lag(ts_ms) OVER (PARTITION BY source ORDER BY ts_ms) AS previous_s FROM ev)
SELECT source, ts_ms, previous_s, ts_ms - previous_s AS gap_s FROM r WHERE category = 'signup' AND previous_s IS NOT NULL""")
def unclean_sessions(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("boot", F.col("category") == "signup")
    return hardware.unclean_sessions(e, ["source"], "ts_ms", "boot").select("source", "ts_ms", "previous_s", "gap_s")


_BALANCE = "round(abs(s_acctbal), 1)"


@query(f"SELECT s_suppkey, unnest(['temp', 'temp', 'fan', 'volt']) AS kind, unnest([s_name || '/CPU/Core', s_name || '/CPU/Cover', s_name || '/Fan', s_name || '/Rail']) AS sensor, unnest([{_BALANCE}, round((s_nationkey + 50 - 32) / 1.8::DOUBLE, 4), CAST(s_suppkey AS DOUBLE), CAST(s_nationkey AS DOUBLE)]) AS value FROM supplier")
def sensor_tree(spark, sf_dir):
    """Nodes of a sensor service's tree for each supplier: comma decimals, Fahrenheit, nodes without a unit left out."""
    n, core = F.col("s_suppkey").cast("string"), F.replace(F.format_string("%.1f", F.round(F.abs("s_acctbal"), 1)), F.lit("."), F.lit(","))
    nation = F.col("s_nationkey")
    tree = F.concat(F.lit('{"Text": "'), "s_name", F.lit('", "Value": "", "Children": [{"Text": "CPU", "Value": "", "Children": [{"Text": "Core", "Value": "'), core, F.lit(' °C"}, {"Text": "Cover", "Value": "'), (nation + 50).cast("string"), F.lit('.0 °F"}]}, {"Text": "Fan", "Value": "'), n, F.lit(' RPM"}, {"Text": "Rail", "Value": "'), nation.cast("string"), F.lit(',0 V"}, {"Text": "Clock", "Value": "3 GHz"}]}'))
    return hardware.sensor_tree(table(spark, sf_dir, "supplier").select("s_suppkey", tree.alias("tree")), ["s_suppkey"], "tree").select("s_suppkey", "kind", "sensor", F.round("value", 4).alias("value"))


def ledger(spark, sf_dir) -> DataFrame:
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(n.alias("seq"), (F.lit(_NOW) - (n * 1000)).alias("ts_ms"), (n % 5).cast("int").alias("priority"), (n % 3 != 0).alias("needs_eyes"), F.when(n % 7 == 0, F.lit(_NOW)).alias("examined_ms"), "n_chars")


@query(f"""SELECT doc_id AS seq, CAST(doc_id % 5 AS INTEGER) AS priority FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id * 1000 < 900000 ORDER BY doc_id % 5, doc_id LIMIT 50""")
def awaiting_frames(spark, sf_dir):
    return retention.awaiting(ledger(spark, sf_dir), _NOW).select("seq", "priority")


@query("""WITH d AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 10 = 0 THEN 2 WHEN source IN ('src0', 'src1') THEN 1 ELSE 0 END AS tier, CAST(doc_id % 10 AS DOUBLE) / 10 AS interest FROM documents), u AS (SELECT sum(n_chars) AS used FROM d),
k AS (SELECT * FROM d WHERE tier < 2 UNION ALL (SELECT * FROM d WHERE tier = 2 ORDER BY interest, doc_id LIMIT 20)),
r AS (SELECT *, sum(n_chars) OVER (ORDER BY tier, interest, doc_id) - n_chars AS before FROM k)
SELECT doc_id, tier, CAST(before AS BIGINT) AS freed_before FROM r, u WHERE used - before > least(750000, 0.5 * used) - 50000""")
def evict_low_disk(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", ((F.col("doc_id") % 10).cast("double") / 10).alias("interest"), "source")
    tier = F.when(F.col("doc_id") % 10 == 0, 2).when(F.col("source").isin("src0", "src1"), 1).otherwise(0)
    return retention.eviction_low_disk(d, "n_chars", tier, "interest", "doc_id", "doc_id", 1_000_000, 50_000).select("doc_id", "tier", "freed_before")


@query("""SELECT event_id, CASE WHEN event_type = 'view' AND user_id % 5 = 0 THEN 0.3 WHEN value <= 10 AND k <= 10 THEN 0.2 WHEN user_id % 4 = 0 AND value <= 10 THEN 0.4 WHEN event_type = 'error' THEN 0.9 WHEN value <= 10 THEN 0.6 WHEN k <= 10 THEN 0.7 ELSE 0.85 END::DOUBLE AS confidence,
CASE WHEN event_type = 'view' AND user_id % 5 = 0 THEN 'not running' WHEN value <= 10 AND k <= 10 THEN 'nothing to see' WHEN user_id % 4 = 0 AND value <= 10 THEN 'screen unreadable and no log' WHEN event_type = 'error' THEN 'error seen' WHEN value <= 10 THEN 'no log' WHEN k <= 10 THEN 'no image' ELSE 'complete' END AS why
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def self_evaluation(spark, sf_dir):
    """Events as snapshots: small values have no log, small k no image, some users' screens are unreadable, some views have no program."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    confidence, why = retention.self_evaluation(~((kind == "view") & (F.col("user_id") % 5 == 0)), kind == "error", F.col("value") > 10, k > 10, F.col("user_id") % 4 == 0)
    return table(spark, sf_dir, "events").select("event_id", confidence.alias("confidence"), why.alias("why"))


@query("SELECT CAST(sum(CAST(ceil(n_chars / 4) AS BIGINT) * (doc_id % 4 + 1)) AS BIGINT) AS tokens_before, CAST(sum(CAST(ceil(n_chars / 4) AS BIGINT)) AS BIGINT) AS tokens_after, count(*) AS rows, round(1 - sum(CAST(ceil(n_chars / 4) AS BIGINT))::DOUBLE / sum(CAST(ceil(n_chars / 4) AS BIGINT) * (doc_id % 4 + 1)), 6) AS saved FROM documents")
def collapse_totals(spark, sf_dir):
    return retention.collapse_totals(table(spark, sf_dir, "documents").withColumn("repeat", F.col("doc_id") % 4 + 1), "n_chars", "repeat")


@query(f"""WITH {EV}, r AS (SELECT source, value, row_number() OVER (PARTITION BY source ORDER BY ts_ms DESC, event_id DESC) AS i FROM ev QUALIFY i <= 100),
g AS (SELECT source, arg_max(value, i) AS first, arg_min(value, i) AS last, count(*) AS n FROM r GROUP BY 1)
SELECT source, first, last, n, CASE WHEN (last - first) / nullif(abs(first), 0) > 0.1 THEN 'rising' WHEN (last - first) / nullif(abs(first), 0) < -0.1 THEN 'falling' ELSE 'steady' END AS trend FROM g""")
def progression(spark, sf_dir):
    return retention.progression(events(spark, sf_dir), ["source"], ["ts_ms", "event_id"], "value")


def screens(spark, sf_dir) -> DataFrame:
    score = F.when(F.col("value") < 60, 0.0).when(F.col("value") < 90, 0.1).otherwise(0.5)
    return events(spark, sf_dir).select("source", "ts_ms", score.alias("score"), (F.col("category") == "view").alias("blank"), (F.col("category") == "error").alias("screen_error"))


@query(f"""WITH {EV}, s AS (SELECT source, ts_ms, CASE WHEN value < 60 THEN 0.0 WHEN value < 90 THEN 0.1 ELSE 0.5 END AS score, CASE WHEN category = 'error' THEN 'screen_error' WHEN category = 'view' THEN 'blank' WHEN value >= 90 THEN 'layout_change' ELSE '' END AS kind FROM ev),
m AS (SELECT *, CASE WHEN score < 0.008 THEN 0 ELSE 1 END AS f, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS k FROM s WINDOW w AS (PARTITION BY source ORDER BY ts_ms)),
i AS (SELECT *, sum(f) OVER (PARTITION BY source ORDER BY ts_ms) AS fi, sum(k) OVER (PARTITION BY source ORDER BY ts_ms) AS ki FROM m)
SELECT source, 'freeze' AS kind, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS frames FROM i GROUP BY source, fi HAVING max(ts_ms) - min(ts_ms) >= 5000
UNION ALL SELECT source, any_value(kind), min(ts_ms), max(ts_ms), count(*) FROM i GROUP BY source, ki HAVING any_value(kind) <> ''""")
def visual_events(spark, sf_dir):
    return visual.visual_events(screens(spark, sf_dir), ["source"], "ts_ms", "score", "blank", "screen_error")


@query("""WITH b AS (SELECT vec_id, list_filter(list_transform(range(0, len(embedding)), lambda i: CASE WHEN abs(embedding[i + 1]) >= 0.15 THEN i END), lambda i: i IS NOT NULL) AS c FROM embeddings),
x AS (SELECT vec_id, list_min(list_transform(c, lambda i: i % 8)) AS x0, list_max(list_transform(c, lambda i: i % 8)) AS x1, list_min(list_transform(c, lambda i: i // 8)) AS y0, list_max(list_transform(c, lambda i: i // 8)) AS y1 FROM b WHERE len(c) > 0)
SELECT vec_id, x0 * 100 AS x, y0 * 50 AS y, (x1 - x0 + 1) * 100 AS w, (y1 - y0 + 1) * 50 AS h FROM x""")
def change_boxes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    box = visual.change_box(F.transform("embedding", lambda x: F.lit(0.0)), F.transform("embedding", lambda x: x.cast("double")), 8, 8, F.lit(800), F.lit(400), 0.15)
    return e.select("vec_id", box.alias("b")).filter(F.col("b").isNotNull()).select("vec_id", "b.*")


def sessions_state(spark, sf_dir) -> DataFrame:
    """A state per user: what holds follows from the user's number."""
    u = F.col("u")
    return events(spark, sf_dir).groupBy("source").agg(F.min("user_id").alias("u")).select(
        "source", (u % 11 != 0).alias("running"), F.when(u % 4 == 0, F.array(F.concat(F.lit("fp"), u.cast("string")))).otherwise(F.array().cast("array<string>")).alias("new_errors"), F.when(u % 6 == 0, F.array(F.lit("old"))).otherwise(F.array().cast("array<string>")).alias("recurring_errors"),
        (u % 5 == 0).alias("stuck"), F.lit(False).alias("anomaly"), F.lit(False).alias("blank"), F.lit(0).alias("expiring"), (u % 2).alias("awaiting"), F.when(u % 7 == 0, F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>")).alias("cleared_errors"), (u % 10 == 3).alias("started"),
    )


_BUILT = f"""{EV}, us AS (SELECT source, min(user_id) AS u FROM ev GROUP BY 1), sg AS (
SELECT source, u, 'resolved' AS kind, 'notice' AS tier, 'gone' AS fp, true AS correction, 2 AS rank FROM us WHERE u % 7 = 0 UNION ALL SELECT source, u, 'new_error', 'alert', 'fp' || u, false, 3 FROM us WHERE u % 4 = 0
UNION ALL SELECT source, u, 'not_running', 'alert', '', false, 3 FROM us WHERE u % 11 = 0 UNION ALL SELECT source, u, 'recurring_error', 'notice', 'old', false, 2 FROM us WHERE u % 6 = 0 UNION ALL SELECT source, u, 'stuck', 'notice', '', false, 2 FROM us WHERE u % 5 = 0
UNION ALL SELECT source, u, 'awaiting', 'heartbeat', '', false, 1 FROM us WHERE u % 2 = 1 UNION ALL SELECT source, u, 'started', 'heartbeat', '', false, 1 FROM us WHERE u % 10 = 3)"""


@query(f"WITH {_BUILT} SELECT source, kind, tier, fp, correction, CAST(rank AS INTEGER) AS rank, substr(sha1(tier || chr(1) || kind || chr(1) || fp), 1, 12) AS identity FROM sg")
def built_signals(spark, sf_dir):
    return signals.built(sessions_state(spark, sf_dir), ["source"]).select("source", "kind", "tier", "fp", "correction", F.col("rank").cast("int").alias("rank"), "identity")


@query(f"""WITH {_BUILT}, s AS (SELECT * FROM sg WHERE correction OR NOT (u % 3 = 0 AND kind = 'stuck')), t AS (SELECT *, max(rank) OVER (PARTITION BY source) AS top, bool_or(kind = 'started') OVER (PARTITION BY source) AS st FROM s),
o AS (SELECT * FROM t WHERE (top > 1 OR st) AND NOT (top = 2 AND u % 3 = 0 AND u % 5 = 0)),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY correction DESC, kind, fp) AS p FROM o WHERE rank = top OR correction) SELECT source, kind, fp FROM c WHERE p <= 3""")
def decided_signals(spark, sf_dir):
    """Users in threes have been told that they are stuck a moment ago: that is not said again, nor any other notice within its gap."""
    built = signals.built(sessions_state(spark, sf_dir), ["source"])
    third = F.substring("source", 6, 20).cast("long") % 3 == 0
    said = built.filter((F.col("kind") == "stuck") & third).select("source", "kind", "fp", "rank", F.lit(990.0).alias("at_s"))
    return signals.decided(built, said, ["source"], 1000.0).select("source", "kind", "fp")


@query(f"""WITH {EV} SELECT source, bool_or(t) AS tracked FROM (SELECT DISTINCT source, false AS t FROM ev WHERE category = 'error' AND ts_ms < {T0} UNION ALL SELECT DISTINCT source, true FROM ev WHERE category = 'signup' AND ts_ms < {T0 - 3 * DAY})
WHERE source NOT IN (SELECT source FROM ev WHERE category = 'error' AND ts_ms BETWEEN {T0} AND {T0 + DAY}) GROUP BY 1""")
def retractions(spark, sf_dir):
    e = events(spark, sf_dir)
    claimed, tracked = e.filter((F.col("category") == "error") & (F.col("ts_ms") < T0)), e.filter((F.col("category") == "signup") & (F.col("ts_ms") < T0 - 3 * DAY))
    live = e.filter((F.col("category") == "error") & F.col("ts_ms").between(T0, T0 + DAY))
    return signals.retractions(tracked.select("source").distinct(), live, claimed.select("source").distinct(), ["source"])


@query(f"WITH {EV}, b AS (SELECT source, max(ts_ms) AS s FROM ev WHERE category = 'signup' GROUP BY 1) SELECT event_id FROM ev LEFT JOIN b ON ev.source = b.source WHERE s IS NULL OR ts_ms >= s")
def since_baseline(spark, sf_dir):
    e = events(spark, sf_dir)
    return signals.since_baseline(e, e.filter("category = 'signup'").select("source", F.col("ts_ms").alias("set_ms")), ["source"], "ts_ms").select("event_id")


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT source, ts_ms, event_id, row_number() OVER (PARTITION BY source ORDER BY ts_ms, event_id) AS i FROM ev WHERE event_id % 30 <= 20),
g AS (SELECT source, i, ts_ms, event_id, ts_ms AS last, true AS ok FROM o WHERE i = 1 UNION ALL SELECT o.source, o.i, o.ts_ms, o.event_id, CASE WHEN o.ts_ms - g.last >= {6 * HOUR} THEN o.ts_ms ELSE g.last END, o.ts_ms - g.last >= {6 * HOUR} FROM g JOIN o ON o.source = g.source AND o.i = g.i + 1)
SELECT source, ts_ms, event_id FROM g WHERE ok""")
def emergency_passes(spark, sf_dir):
    return signals.spaced(events(spark, sf_dir).withColumn("unseen", ident() % 30), "source", "ts_ms", "event_id", 6 * HOUR)


def marks(e: DataFrame) -> DataFrame:
    return e.filter(F.col("category") == "error").select("source", F.col("event_id").alias("id"), "ts_ms")


@query(f"""WITH {EV}, p AS (SELECT source, event_id AS id, ts_ms FROM ev WHERE category = 'error'), s AS (SELECT source, ts_ms, max(event_id) AS i FROM ev WHERE category = 'purchase' GROUP BY 1, 2),
a AS (SELECT p.*, s.i AS state_id FROM p ASOF LEFT JOIN s ON p.source = s.source AND p.ts_ms >= s.ts_ms),
n AS (SELECT p.id, count(*) AS n, count(*) FILTER (WHERE e.level = 'ERROR') AS k FROM p JOIN ev e ON p.source = e.source AND e.ts_ms BETWEEN p.ts_ms - {6 * HOUR} AND p.ts_ms + {6 * HOUR} GROUP BY 1)
SELECT a.id, a.ts_ms, a.state_id, coalesce(n.n, 0) AS rows_near, coalesce(n.k, 0) AS errors_near FROM a LEFT JOIN n ON a.id = n.id""")
def error_moments(spark, sf_dir):
    e = events(spark, sf_dir)
    states = e.filter(F.col("category") == "purchase").select("source", F.col("ts_ms").alias("s_ts_ms"), F.col("event_id").alias("s_id"))
    logs = e.select("source", F.col("ts_ms").alias("r_ts_ms"), F.col("level").alias("r_level"))
    found = composites.error_moment(marks(e), states, logs, states, ["source"], 6 * HOUR)
    return found.select("id", "ts_ms", F.col("state.s_id").alias("state_id"), "rows_near", "errors_near")


@query(f"""WITH {EV}, b AS (SELECT ts_ms, 'frame' AS kind, 'f' || event_id AS line FROM ev WHERE category = 'view' UNION ALL SELECT ts_ms, 'log', 'l' || event_id FROM ev WHERE category = 'click' UNION ALL SELECT ts_ms, 'bookmark', 'b' || event_id FROM ev WHERE category = 'error')
SELECT * FROM b WHERE ts_ms BETWEEN {T0} AND {T0 + 5 * DAY} ORDER BY ts_ms DESC, kind, line LIMIT 200""")
def combined_timeline(spark, sf_dir):
    e = events(spark, sf_dir)
    of = lambda category, mark: e.filter(F.col("category") == category).select("ts_ms", F.concat(F.lit(mark), ident().cast("string")).alias("line"))
    return composites.combined_timeline(of("view", "f"), of("click", "l"), of("error", "b"), T0, T0 + 5 * DAY)


@query(f"WITH {EV} SELECT count(*) AS events, count(*) FILTER (WHERE level = 'ERROR') AS errors, {_NOW} - max(ts_ms) AS age_ms, CAST(1 AS BIGINT) AS fingerprints, count(*) FILTER (WHERE level = 'ERROR') AS top_count FROM ev")
def digest(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("message", F.concat(F.lit("failed "), ident().cast("string")))
    return composites.digest(e, "message", _NOW).select("events", "errors", F.col("age_ms").cast("long").alias("age_ms"), "fingerprints", "top_count")


@query(f"""WITH {EV}, d AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE level = 'ERROR') AS errors, count(*) FILTER (WHERE level = 'WARN') AS warnings FROM ev GROUP BY 1),
c AS (SELECT source, category, count(*) AS k FROM ev GROUP BY 1, 2), b AS (SELECT source, arg_max(category, (k, category)) AS busiest FROM c GROUP BY 1)
SELECT d.source, errors, warnings, round(greatest(0, 100 - least(60.0::DOUBLE, errors / n * 150) - least(20.0::DOUBLE, warnings / n * 50)), 4) AS score, busiest FROM d JOIN b ON d.source = b.source""")
def session_reports(spark, sf_dir):
    return composites.session_report(events(spark, sf_dir), ["source"], F.col("level") == "ERROR", F.col("level") == "WARN").select("source", "errors", "warnings", "score", "busiest")


@query(f"""WITH {EV}, c AS (SELECT count(*) AS events, count(DISTINCT source) AS sources, count(*) FILTER (WHERE level = 'ERROR') AS errors, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM ev), l AS (SELECT source, count(*) AS k FROM ev WHERE level = 'ERROR' GROUP BY 1)
SELECT events, sources, errors, first_ms, last_ms, (SELECT arg_max(source, (k, source)) FROM l) AS worst_source FROM c""")
def overview(spark, sf_dir):
    return composites.overview(events(spark, sf_dir))


@query(f"""WITH {EV}, f AS (SELECT event_id AS seq, ts_ms FROM ev WHERE category = 'view'), g AS (SELECT event_id - 1 AS seq, ts_ms AS r FROM ev), l AS (SELECT seq, max(r) AS last_ms, count(*) AS n FROM g GROUP BY 1)
SELECT f.seq, last_ms, n, coalesce(last_ms <= f.ts_ms + 50, true) AS aligned FROM f LEFT JOIN l ON f.seq = l.seq""")
def shutter_alignment(spark, sf_dir):
    e = events(spark, sf_dir)
    return composites.alignment(e.filter("category = 'view'").select(F.col("event_id").alias("seq"), "ts_ms"), e.select((ident() - 1).alias("seq"), F.col("ts_ms").alias("r_ts_ms"))).select("seq", "last_ms", "n", "aligned")


@query(f"""WITH {EV}, s AS (SELECT source, ts_ms, event_id, CASE WHEN value < 80 THEN 1 ELSE 9 END AS d, event_id // 4000 AS size FROM ev), m AS (SELECT *, CASE WHEN d <= 2 AND lag(d) OVER w <= 2 THEN 0 ELSE 1 END AS x FROM s WINDOW w AS (PARTITION BY source ORDER BY ts_ms, event_id)),
i AS (SELECT *, sum(x) OVER (PARTITION BY source ORDER BY ts_ms, event_id) AS island FROM m), r AS (SELECT *, row_number() OVER w AS streak, first_value(size) OVER w AS f FROM i WINDOW w AS (PARTITION BY source, island ORDER BY ts_ms, event_id))
SELECT event_id, CAST(streak AS INTEGER) AS streak FROM r WHERE d <= 2 AND streak >= 5 AND size <= f""")
def stuck_screens(spark, sf_dir):
    """Five or more like frames in a row while the log has not grown."""
    e = events(spark, sf_dir).withColumn("d", F.when(F.col("value") < 80, 1).otherwise(9)).withColumn("size", F.floor(ident() / 4000))
    return sequence.stuck(e, ["source"], ["ts_ms", "event_id"], "d", "size").select("event_id", F.col("streak").cast("int").alias("streak"))


@query(f"""WITH {EV}, r AS (SELECT source, count(*) FILTER (WHERE category = 'error') AS failed, count(*) FILTER (WHERE category = 'purchase') AS succeeded, arg_max(props, (ts_ms, event_id)) FILTER (WHERE category = 'error') AS b, arg_max(props, (ts_ms, event_id)) FILTER (WHERE category = 'purchase') AS g FROM ev GROUP BY 1)
SELECT source, failed, succeeded, CASE WHEN json_extract_string(b, '$.k') <> json_extract_string(g, '$.k') THEN json_extract_string(b, '$.k') END AS k_from, CASE WHEN json_extract_string(b, '$.k') <> json_extract_string(g, '$.k') THEN json_extract_string(g, '$.k') END AS k_to FROM r WHERE failed > 0 AND succeeded > 0""")
def recovery_changes(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("state", F.from_json("props", "map<string,string>"))
    found = errors.recovery(e, "source", F.col("category") == "error", F.col("category") == "purchase", "state", ["ts_ms", "event_id"])
    k = F.try_element_at("changed", F.lit("k"))
    return found.select("source", "failed", "succeeded", k["from"].alias("k_from"), k["to"].alias("k_to"))


@query(f"""WITH {EV}, r AS (SELECT source, category, row_number() OVER (PARTITION BY source ORDER BY ts_ms DESC, event_id DESC) AS i FROM ev)
SELECT source, round(avg(CASE WHEN category = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS error_rate, count(*) AS n FROM r WHERE i <= 50 GROUP BY 1""")
def recent_error_rates(spark, sf_dir):
    return health.error_rate(events(spark, sf_dir), ["source"], ["ts_ms", "event_id"], F.col("category") == "error")


@query(f"""WITH {EV}, x AS (SELECT source, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, ts_ms >= {T0} AND ts_ms < {T0 + 5 * DAY} AS w FROM ev),
a AS (SELECT source, 'value' AS field, round((avg(value) FILTER (WHERE w) - avg(value)) / nullif(stddev_samp(value), 0), 6) AS z FROM x GROUP BY 1 UNION ALL SELECT source, 'k', round((avg(k) FILTER (WHERE w) - avg(k)) / nullif(stddev_samp(k), 0), 6) FROM x GROUP BY 1)
SELECT source, field, z, CAST(row_number() OVER (PARTITION BY source ORDER BY abs(z) DESC, field) AS INTEGER) AS rank FROM a WHERE z IS NOT NULL""")
def ranked_outliers(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return health.ranked_outliers(e, ["source"], ["value", "k"], (F.col("ts_ms") >= T0) & (F.col("ts_ms") < T0 + 5 * DAY))


@query(f"SELECT s_suppkey, unnest(['temps', 'fans', 'volts']) AS kind, unnest([2, 1, 1])::BIGINT AS n, unnest([greatest({_BALANCE}, round((s_nationkey + 50 - 32) / 1.8::DOUBLE, 4)), CAST(s_suppkey AS DOUBLE), CAST(s_nationkey AS DOUBLE)]) AS highest FROM supplier")
def sensor_samples_from_trees(spark, sf_dir):
    """One sample a tree: maps by sensor, with their sizes and highest values."""
    sample = hardware.sample_maps(hardware_tree(spark, sf_dir), ["s_suppkey"])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.size(k).cast("long").alias("n"), F.array_max(F.map_values(k)).alias("highest")) for k in ("temps", "fans", "volts")])).alias("x")
    return sample.select("s_suppkey", kinds).select("s_suppkey", "x.kind", "x.n", F.round("x.highest", 4).alias("highest"))


def hardware_tree(spark, sf_dir) -> DataFrame:
    return sensor_tree(spark, sf_dir)
