"""The query catalogue over the shipped tables: each query with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import levels, text, timeparse
from ..operators import errors, hardware, health, parsing, retention, roles, sequence, signals, state, temporal, timeline, visual

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Queries that SQL cannot express; the tests hold them against known rows.
WITHOUT_SQL: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

DAY, HOUR, MINUTE = 86_400_000, 3_600_000, 60_000
T0 = 1_704_412_800_000  # 2024-01-05
#: The events table as unified events, in SQL.
EV = """ev AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, event_type AS category,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'TRACE' ELSE 'INFO' END AS level,
         'user_' || user_id AS source, user_id, value, props
  FROM events)"""
#: Log lines made of events: counts, codes and addresses as programs print them.
LINES_SQL = """lines AS (
  SELECT event_id, user_id, event_type, '[' || event_type || '] src=0x' || printf('%06x', user_id + 65536) || ' dst=0x' || printf('%06x', CAST(json_extract(props, '$.k') AS BIGINT) + 131072)
         || ' rc=' || (event_id % 3) || ' status=' || (100 + 50 * (event_id % 9)) || ' dropped=' || (event_id % 2) AS line
  FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.from_events(table(spark, sf_dir, "events"))


def lines_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    hexed = lambda c: F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(c), 6, "0")))
    k = F.get_json_object("props", "$.k").cast("long")
    line = F.concat(
        F.lit("["), F.col("event_type"), F.lit("] src="), hexed(F.col("user_id") + 65536), F.lit(" dst="), hexed(k + 131072),
        F.lit(" rc="), (F.col("event_id") % 3).cast("string"), F.lit(" status="), (100 + 50 * (F.col("event_id") % 9)).cast("string"), F.lit(" dropped="), (F.col("event_id") % 2).cast("string"),
    )
    return e.select("event_id", "user_id", "event_type", line.alias("line"))


def without_sql(f):
    WITHOUT_SQL[f.__name__] = f
    return f


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return d.filter(F.trim("line") != "")


DOC_LINES = """dl AS (
  SELECT doc_id, source, line_no, line FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) WHERE trim(line) <> '')"""


@query(f"WITH {EV} SELECT event_id, ts_ms, level, category, source FROM ev WHERE ts_ms BETWEEN {T0} AND {T0 + 7 * DAY}")
def timeline_window(spark, sf_dir):
    stored = timeline.in_window(table(spark, sf_dir, "events"), T0, T0 + 7 * DAY, stamp="ts")
    return timeline.in_order(schema.from_events(stored), "event_id").select("event_id", "ts_ms", "level", "category", "source")


@query(f"WITH {EV} SELECT event_id, ts_ms, level FROM ev WHERE level IN ('WARN', 'ERROR', 'FATAL')")
def timeline_min_level(spark, sf_dir):
    return timeline.at_least(events(spark, sf_dir), "WARN").select("event_id", "ts_ms", "level")


@query(f"WITH {EV} SELECT event_id, ts_ms, level FROM ev ORDER BY ts_ms DESC, event_id DESC LIMIT 500")
def timeline_latest_n(spark, sf_dir):
    return timeline.latest(events(spark, sf_dir), 500, "event_id").select("event_id", "ts_ms", "level")


@query("""SELECT 'events' AS label, epoch_us(ts) // 1000 AS ts_ms, 'user_' || user_id AS source, event_type AS message FROM events
UNION ALL SELECT 'orders', epoch_us(o_orderdate) // 1000, 'customer_' || o_custkey, o_orderpriority FROM orders""")
def merge_sources(spark, sf_dir):
    e = events(spark, sf_dir).select(F.lit("events").alias("label"), "ts_ms", "source", F.col("category").alias("message"))
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("label"), timeparse.ntz_ms(F.col("o_orderdate")).alias("ts_ms"), F.concat(F.lit("customer_"), F.col("o_custkey").cast("string")).alias("source"), F.col("o_orderpriority").alias("message"))
    return timeline.merged(e, o)


@query(f"WITH {EV} SELECT category, coalesce(json_extract_string(props, '$.name'), '') AS name, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM ev GROUP BY 1, 2")
def event_vocabulary(spark, sf_dir):
    return timeline.vocabulary(events(spark, sf_dir))


FP = r"substr(sha1(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '0x[0-9a-fA-F]+', '0xHEX', 'g'), '[A-Za-z]:[\\/][^\s:''\",)\]]+', '/PATH', 'g'), '/[^\s:]+', '/PATH', 'g'), '\d+', 'N', 'g'), '\s+', ' ', 'g'))), 1, 12)"


@query(f"WITH {DOC_LINES} SELECT {FP} AS fp, count(*) AS n, min(line) AS sample, min(source) AS source, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM dl GROUP BY 1")
def errors_by_fingerprint(spark, sf_dir):
    return errors.histogram(document_lines(spark, sf_dir), "line", "doc_id", "source")


@query(f"WITH {DOC_LINES}, l AS (SELECT {FP} AS fp, doc_id FROM dl) SELECT fp, count(*) AS n, min(doc_id) AS first_seen FROM l GROUP BY 1 HAVING min(doc_id) >= 150")
def new_errors_since(spark, sf_dir):
    return errors.new_since(errors.histogram(document_lines(spark, sf_dir), "line", "doc_id", "source"), 150).select("fp", "n", "first_seen")


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_ms DESC, event_id DESC) AS i FROM ev),
t AS (SELECT source, i, category, count(*) OVER (PARTITION BY source) AS n FROM r WHERE i <= 20),
h AS (SELECT source, count(*) AS frames, CAST(coalesce(sum(CASE WHEN i <= floor(n / 2) AND category = 'error' THEN 1 END), 0) AS BIGINT) AS newer, CAST(coalesce(sum(CASE WHEN i > floor(n / 2) AND category = 'error' THEN 1 END), 0) AS BIGINT) AS older FROM t GROUP BY source)
SELECT source, frames, newer, older, CASE WHEN frames < 4 THEN 'unknown' WHEN newer > older THEN 'rising' WHEN newer < older THEN 'falling' ELSE 'steady' END AS trend FROM h""")
def error_trend(spark, sf_dir):
    return errors.trend(events(spark, sf_dir), ["source"], ["ts_ms", "event_id"], F.col("category") == "error")


@query(f"WITH {EV} SELECT event_id, ts_ms, source FROM ev WHERE category = 'error' OR json_extract_string(props, '$.name') = 'run.fail' OR regexp_matches(lower(source), 'fail|error|crash')")
def failure_bookmarks(spark, sf_dir):
    return events(spark, sf_dir).filter(timeline.failure_trigger()).select("event_id", "ts_ms", "source")


@query(f"""WITH {EV} SELECT b.event_id, count(*) AS n, count(*) FILTER (WHERE e.ts_ms < b.ts_ms) AS n_before, count(*) FILTER (WHERE e.category = 'error') AS n_errors
FROM ev b JOIN ev e ON b.category = 'error' AND b.source = e.source AND e.ts_ms BETWEEN b.ts_ms - {12 * HOUR} AND b.ts_ms + {4 * HOUR} GROUP BY 1""")
def bookmark_context(spark, sf_dir):
    e = events(spark, sf_dir)
    marks = e.filter(F.col("category") == "error").select("source", "event_id", "ts_ms")
    near = temporal.interval_join(marks, e.select("source", F.col("ts_ms").alias("r_ts_ms"), F.col("category").alias("r_category")), 12 * HOUR, 4 * HOUR, ["source"])
    return near.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(F.col("r_ts_ms") < F.col("ts_ms")).alias("n_before"), F.count_if(F.col("r_category") == "error").alias("n_errors"))


@query(f"""WITH {EV} SELECT f.event_id AS frame, count(*) AS n, CAST(sum(a.event_id) AS BIGINT) AS id_sum FROM ev f JOIN ev a ON f.category = 'purchase' AND a.category = 'click' AND a.ts_ms BETWEEN f.ts_ms - {20 * MINUTE} AND f.ts_ms + {20 * MINUTE} GROUP BY 1""")
def actions_around(spark, sf_dir):
    e = events(spark, sf_dir)
    frames = e.filter(F.col("category") == "purchase").select(F.col("event_id").alias("frame"), "ts_ms")
    clicks = e.filter(F.col("category") == "click").select("event_id", F.col("ts_ms").alias("r_ts_ms"))
    return temporal.interval_join(frames, clicks, 20 * MINUTE, 20 * MINUTE).groupBy("frame").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query(f"""WITH {EV}, s AS (SELECT source, ts_ms, max(event_id) AS event_id FROM ev WHERE category = 'purchase' GROUP BY 1, 2)
SELECT p.event_id, p.ts_ms, s.ts_ms AS state_ms, s.event_id AS state_id FROM (SELECT * FROM ev WHERE category = 'error') p ASOF LEFT JOIN s ON p.source = s.source AND p.ts_ms >= s.ts_ms""")
def state_at(spark, sf_dir):
    e = events(spark, sf_dir)
    states = e.filter(F.col("category") == "purchase").select("source", F.col("ts_ms").alias("s_ts_ms"), F.col("event_id").alias("s_id"))
    return temporal.as_of(e.filter(F.col("category") == "error").select("source", "ts_ms", "event_id"), states, ["source"]).select("event_id", "ts_ms", F.col("state.s_ts_ms").alias("state_ms"), F.col("state.s_id").alias("state_id"))


@query(f"""WITH {EV}, s AS (SELECT source, ts_ms, max(event_id) AS event_id FROM ev WHERE category = 'purchase' GROUP BY 1, 2),
n AS (SELECT source, ts_ms, min(event_id) AS event_id FROM ev WHERE category = 'purchase' GROUP BY 1, 2),
p AS (SELECT event_id, source, ts_ms FROM ev WHERE category = 'error'),
b AS (SELECT p.*, s.ts_ms AS b_ms, s.event_id AS b_id FROM p ASOF LEFT JOIN s ON p.source = s.source AND p.ts_ms >= s.ts_ms),
a AS (SELECT b.*, n.ts_ms AS a_ms, n.event_id AS a_id FROM b ASOF LEFT JOIN n ON b.source = n.source AND b.ts_ms <= n.ts_ms)
SELECT event_id, ts_ms, CASE WHEN a_ms IS NULL OR ts_ms - b_ms <= a_ms - ts_ms THEN b_ms ELSE a_ms END AS state_ms, CASE WHEN a_ms IS NULL OR ts_ms - b_ms <= a_ms - ts_ms THEN b_id ELSE a_id END AS state_id FROM a""")
def state_nearest(spark, sf_dir):
    e = events(spark, sf_dir)
    states = e.filter(F.col("category") == "purchase").select("source", F.col("ts_ms").alias("s_ts_ms"), F.col("event_id").alias("s_id"))
    return temporal.nearest(e.filter(F.col("category") == "error").select("source", "ts_ms", "event_id"), states, ["source"]).select("event_id", "ts_ms", F.col("state.s_ts_ms").alias("state_ms"), F.col("state.s_id").alias("state_id"))


def _latest_state(e: DataFrame, at_ms: int) -> DataFrame:
    return e.filter(F.col("ts_ms") <= at_ms).groupBy("source").agg(F.max_by("props", F.struct("ts_ms", "event_id")).alias("props"))


@query(f"""WITH {EV}, a AS (SELECT source, arg_max(props, (ts_ms, event_id)) AS v FROM ev WHERE ts_ms <= {T0} GROUP BY 1), b AS (SELECT source, arg_max(props, (ts_ms, event_id)) AS v FROM ev WHERE ts_ms <= {T0 + 5 * DAY} GROUP BY 1)
SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.source IS NULL THEN 'added' WHEN b.source IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS from_value, b.v AS to_value
FROM a FULL JOIN b ON a.source = b.source WHERE a.v IS DISTINCT FROM b.v""")
def state_diff(spark, sf_dir):
    e = events(spark, sf_dir)
    return state.state_diff(_latest_state(e, T0), _latest_state(e, T0 + 5 * DAY), ["source"], "props")


@query(f"""WITH {EV}, m AS (SELECT source, max(ts_ms) AS mark_ms FROM ev WHERE category = 'error' GROUP BY 1)
SELECT ev.source, round(avg(value) FILTER (WHERE ts_ms BETWEEN mark_ms - {5 * DAY} AND mark_ms), 6) AS pre_mean, round(avg(value), 6) AS all_mean,
round((avg(value) FILTER (WHERE ts_ms BETWEEN mark_ms - {5 * DAY} AND mark_ms) - avg(value)) / nullif(stddev_samp(value), 0), 6) AS z FROM ev JOIN m ON ev.source = m.source GROUP BY 1""")
def bookmark_outliers(spark, sf_dir):
    e = events(spark, sf_dir)
    marks = e.filter(F.col("category") == "error").groupBy("source").agg(F.max("ts_ms").alias("mark_ms"))
    return health.outliers(e.join(marks, "source"), ["source"], "value", F.col("ts_ms").between(F.col("mark_ms") - 5 * DAY, F.col("mark_ms")))


@query(f"WITH {EV} SELECT event_id, ts_ms, category, source FROM ev WHERE source = 'user_7'")
def trace_timeline(spark, sf_dir):
    return timeline.in_order(events(spark, sf_dir).filter(F.col("source") == "user_7"), "event_id").select("event_id", "ts_ms", "category", "source")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the a')")
def search_substring(spark, sf_dir):
    return timeline.search(table(spark, sf_dir, "documents"), "text", "The A").select("doc_id", "source")


@query(r"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)\bth[aeiou]+n\b')")
def search_regex(spark, sf_dir):
    return timeline.search(table(spark, sf_dir, "documents"), "text", r"\bth[aeiou]+n\b", regex=True).select("doc_id", "source")


_REASON = r"""CASE WHEN regexp_matches(line, '(?i)\bok\s*[=:]\s*(false|0|no)\b') THEN 'ok=false'
 WHEN len(list_filter(regexp_extract_all(line, '(?i)\b(?:errors?|failures?|failed|dropped|lost)\s*[=:]\s*(\d+)\b', 1), lambda x: x <> '0')) > 0 THEN 'non-zero failure count'
 WHEN regexp_matches(line, '(?i)\bstatus\s*[=:]\s*[45]\d\d\b') THEN 'http 4xx/5xx'
 WHEN len(list_filter(regexp_extract_all(line, '(?i)\b(?:rc|exit|exitcode|exit_code|returncode)\s*[=:]\s*(-?\d+)\b', 1), lambda x: x <> '0')) > 0 THEN 'non-zero exit code' END"""


@query(f"WITH {LINES_SQL}, r AS (SELECT event_id, {_REASON} AS reason FROM lines) SELECT event_id, CASE WHEN reason IS NULL THEN 'INFO' ELSE 'WARN' END AS level, reason AS escalation_reason FROM r")
def content_severity(spark, sf_dir):
    level, _, reason = levels.escalated(F.lit("INFO"), F.col("line"))
    return lines_of_events(spark, sf_dir).select("event_id", level.alias("level"), reason.alias("escalation_reason"))


@query(f"WITH {LINES_SQL}, r AS (SELECT event_type, {_REASON} AS reason FROM lines) SELECT event_type, reason, count(*) AS n FROM r GROUP BY 1, 2")
def content_severity_counts(spark, sf_dir):
    return lines_of_events(spark, sf_dir).groupBy("event_type", levels.content_reason(F.col("line")).alias("reason")).agg(F.count("*").alias("n"))


@query(rf"WITH {LINES_SQL}, f AS (SELECT event_id, unnest(regexp_extract_all(line, '([A-Za-z][A-Za-z0-9_#.\-]*)=([^\s,;\])}}]+)', 1)) AS key, unnest(regexp_extract_all(line, '([A-Za-z][A-Za-z0-9_#.\-]*)=([^\s,;\])}}]+)', 2)) AS value FROM lines) SELECT event_id, key, value FROM f")
def extract_fields_long(spark, sf_dir):
    return lines_of_events(spark, sf_dir).select("event_id", F.explode(text.fields(F.col("line"))).alias("key", "value"))


#: All eleven patterns of levels.FAILURE_CONTENT, in their order.
_REASONS = r"""CASE WHEN regexp_matches(line, '(?i)\bok\s*[=:]\s*(?:false|0|no)\b') THEN 'ok=false'
 WHEN regexp_matches(line, '(?i)\b(?:success|succeeded|successful)\s*[=:]\s*(?:false|0|no)\b') THEN 'success=false'
 WHEN regexp_matches(line, '(?i)\b(?:failed|failure|fail)\s*[=:]\s*(?:true|1|yes)\b') THEN 'failed=true'
 WHEN regexp_matches(line, '(?i)\berror\s*[=:]\s*(?:true|yes)\b') THEN 'error=true'
 WHEN len(list_filter(regexp_extract_all(line, '(?i)\b(?:errors?|failures?|failed|dropped|lost)\s*[=:]\s*(\d+)\b', 1), lambda x: x <> '0')) > 0 THEN 'non-zero failure count'
 WHEN regexp_matches(line, '(?i)\bstatus\s*[=:]\s*[45]\d\d\b') THEN 'http 4xx/5xx'
 WHEN len(list_filter(regexp_extract_all(line, '(?i)\b(?:rc|exit|exitcode|exit_code|returncode)\s*[=:]\s*(-?\d+)\b', 1), lambda x: x <> '0')) > 0 THEN 'non-zero exit code'
 WHEN regexp_matches(line, '(?i)\b(?:failed|unable)\s+to\b') THEN 'failed to ...'
 WHEN regexp_matches(line, '(?i)\btimed\s+out\b') THEN 'timed out'
 WHEN regexp_matches(line, '(?i)\btimeout\s+(?:exceeded|expired|after|waiting|reached)\b') THEN 'timeout exceeded'
 WHEN regexp_matches(line, '(?i)\brefused\b|\bunreachable\b') THEN 'connection refused' END"""
#: The lines of documents and of pages without their tags.
TEXT_LINES = r"""tl AS (SELECT origin, id, line_no, line FROM (
  SELECT origin, id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM (
    SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') FROM pages)) WHERE trim(line) <> '')"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    p = table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return d.unionByName(p).select("origin", "id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")


@query(f"WITH {TEXT_LINES}, r AS (SELECT origin, id, line_no, {_REASONS} AS reason FROM tl) SELECT origin, id, line_no, CASE WHEN reason IS NULL THEN 'INFO' ELSE 'WARN' END AS level, reason AS escalation_reason FROM r")
def text_severity(spark, sf_dir):
    level, _, reason = levels.escalated(F.lit("INFO"), F.col("line"))
    return text_lines(spark, sf_dir).select("origin", "id", "line_no", level.alias("level"), reason.alias("escalation_reason"))


@query(f"WITH {TEXT_LINES}, r AS (SELECT origin, {_REASONS} AS reason FROM tl) SELECT origin, reason, count(*) AS n FROM r GROUP BY 1, 2")
def text_severity_counts(spark, sf_dir):
    return text_lines(spark, sf_dir).groupBy("origin", levels.content_reason(F.col("line")).alias("reason")).agg(F.count("*").alias("n"))


_ROLES = r"""f AS (SELECT event_id, '0x' || ltrim(substr(regexp_extract(line, 'src=(0x[0-9a-f]+)', 1), 3), '0') AS address, 'src' AS role, line FROM lines
 UNION ALL SELECT event_id, '0x' || ltrim(substr(regexp_extract(line, 'dst=(0x[0-9a-f]+)', 1), 3), '0'), 'dst', line FROM lines)"""


@query(f"WITH {LINES_SQL}, {_ROLES} SELECT address, role, count(*) AS n, arg_min(line, event_id) AS first_line, arg_max(line, event_id) AS last_line FROM f GROUP BY 1, 2")
def role_index(spark, sf_dir):
    return roles.address_roles(lines_of_events(spark, sf_dir), "line", order=["event_id"])


@query(f"WITH {LINES_SQL}, {_ROLES} SELECT address, count(*) AS total, count(DISTINCT role) AS roles FROM f GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'dst') = 0")
def roles_never(spark, sf_dir):
    return roles.never(roles.address_roles(lines_of_events(spark, sf_dir), "line", order=["event_id"]), "dst")


@query(f"""WITH {DOC_LINES}, m AS (SELECT *, CASE WHEN line IS NOT DISTINCT FROM lag(line) OVER w AND lag(line_no) OVER w IS NOT NULL THEN 0 ELSE 1 END AS s FROM dl WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS island FROM m)
SELECT doc_id, island, any_value(line) AS line, count(*) AS repeat, min(line_no) AS first, max(line_no) AS last FROM i GROUP BY 1, 2""")
def rle_collapse(spark, sf_dir):
    return sequence.run_lengths(document_lines(spark, sf_dir), ["doc_id"], ["line_no"], "line", 100_000).select("doc_id", "island", "line", "repeat", "first", "last")


_RUNS = f"""{EV}, m AS (SELECT *, CASE WHEN category = lag(category) OVER w THEN 0 ELSE 1 END AS s FROM ev WINDOW w AS (PARTITION BY source ORDER BY ts_ms, event_id)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY source ORDER BY ts_ms, event_id) AS BIGINT) AS island FROM m)"""


@query(f"WITH {_RUNS} SELECT source, island, any_value(category) AS category, count(*) AS repeat, min(ts_ms) AS first, max(ts_ms) AS last FROM i GROUP BY 1, 2 HAVING count(*) >= 3")
def stuck_streak(spark, sf_dir):
    return sequence.streaks(events(spark, sf_dir), ["source"], ["ts_ms", "event_id"], "category", 3, 10 * DAY).select("source", "island", "category", "repeat", "first", "last")


@query(f"""WITH {EV}, m AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < {6 * HOUR} THEN 0 ELSE 1 END AS s FROM ev WINDOW w AS (PARTITION BY source ORDER BY ts_ms, event_id)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY source ORDER BY ts_ms, event_id) AS BIGINT) AS session FROM m)
SELECT source, session, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n FROM i GROUP BY 1, 2""")
def session_gap(spark, sf_dir):
    return sequence.sessions(events(spark, sf_dir), ["source"], "ts_ms", 6 * HOUR, "event_id", width=10 * DAY)


@query(f"WITH {EV} SELECT category, ts_ms // {HOUR} * {HOUR} AS start_ms, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    start = (F.floor(F.col("ts_ms") / HOUR) * HOUR).cast("long")
    return events(spark, sf_dir).groupBy("category", start.alias("start_ms")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {EV}, w AS (SELECT category, unnest([ts_ms // {HOUR // 2} * {HOUR // 2} - {HOUR // 2}, ts_ms // {HOUR // 2} * {HOUR // 2}]) AS start_ms FROM ev) SELECT category, start_ms, count(*) AS n FROM w GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    stamped = events(spark, sf_dir).withColumn("at", F.timestamp_millis("ts_ms"))
    return stamped.groupBy("category", F.window("at", "60 minutes", "30 minutes")).agg(F.count("*").alias("n")).select("category", F.unix_millis("window.start").alias("start_ms"), "n")


@query(f"WITH {EV} SELECT category, arg_max(value, (ts_ms, event_id)) AS latest, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(*) AS n FROM ev GROUP BY 1")
def perf_metrics(spark, sf_dir):
    return health.metrics(events(spark, sf_dir).withColumn("at", F.struct("ts_ms", "event_id")), ["category"], "at", "value")


@query(f"""WITH {EV}, l AS (SELECT source, max(ts_ms) AS last FROM ev GROUP BY 1), r AS (SELECT ev.* FROM ev JOIN l ON ev.source = l.source AND ts_ms >= last - {3 * DAY})
SELECT source, round(arg_max(value, ts_ms) - arg_min(value, ts_ms), 6) AS rise, count(*) AS n FROM r GROUP BY 1""")
def metric_slope(spark, sf_dir):
    return sequence.slope(events(spark, sf_dir), ["source"], "ts_ms", "value", 3 * DAY)


_NUMBERED = f"{EV}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_ms, event_id) AS i, row_number() OVER (PARTITION BY source ORDER BY ts_ms DESC, event_id DESC) AS j, count(*) OVER (PARTITION BY source) AS c FROM ev)"


@query(f"""WITH {_NUMBERED}, s AS (SELECT source, median(value) AS m, min(value) FILTER (WHERE i > c / 2) AS low FROM r GROUP BY 1)
SELECT source, round(m, 6) AS median, round(low, 6) AS low, round((m - low) / nullif(m, 0) * 100, 4) AS sag_pct FROM s""")
def sag_vs_median(spark, sf_dir):
    return sequence.sag(events(spark, sf_dir), ["source"], ["ts_ms", "event_id"], "value")


@query(f"""WITH {_NUMBERED}, s AS (SELECT source, max(value) FILTER (WHERE j = 1) AS latest, median(value) FILTER (WHERE j > 1) AS m, count(*) AS n FROM r GROUP BY 1)
SELECT source, round(latest, 6) AS latest, round(m, 6) AS median, n FROM s WHERE n >= 5 AND latest >= 1.5 * m""")
def spike_vs_median(spark, sf_dir):
    return sequence.spikes(events(spark, sf_dir), ["source"], ["ts_ms", "event_id"], "value")


@query(f"""WITH {EV}, d AS (SELECT ts_ms // {DAY} AS day, count(*) AS n, count(*) FILTER (WHERE level = 'ERROR') AS errors, count(*) FILTER (WHERE level = 'WARN') AS warnings, count(*) FILTER (WHERE value > 500) AS anomalies FROM ev GROUP BY 1),
s AS (SELECT *, greatest(0, 100 - (least(60.0::DOUBLE, errors / n * 150) + least(20.0::DOUBLE, warnings / n * 50) + CASE WHEN anomalies > 0 THEN 20 ELSE 0 END)) AS x FROM d)
SELECT day, n, errors, warnings, anomalies, round(x, 4) AS score, CASE WHEN x >= 90 THEN 'A' WHEN x >= 75 THEN 'B' WHEN x >= 50 THEN 'C' ELSE 'D' END AS grade FROM s""")
def health_score(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("ts_ms") / DAY).cast("long"))
    return health.health(e, ["day"], F.col("level") == "ERROR", F.col("level") == "WARN", F.col("value") > 500)


_NOW = 1_706_659_200_000  # 2024-01-31


@query(f"""WITH {EV}, g AS (SELECT source || '/' || category AS cause, max(ts_ms) AS last_ms, count(*) AS n, any_value(CASE level WHEN 'ERROR' THEN 5 WHEN 'WARN' THEN 4 ELSE 1 END) AS sev FROM ev GROUP BY 1),
s AS (SELECT cause, n, last_ms, round(sev * pow(0.5::DOUBLE, greatest(0, ({_NOW} - last_ms) / {DAY}.0::DOUBLE)) * log2(n + 1), 6) AS score FROM g)
SELECT cause, n, last_ms, score, CAST(row_number() OVER (ORDER BY score DESC, cause) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (ORDER BY score DESC, cause) <= 6""")
def diagnose_rank(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("sev", F.when(F.col("level") == "ERROR", 5).when(F.col("level") == "WARN", 4).otherwise(1))
    g = e.groupBy(F.concat_ws("/", "source", "category").alias("cause")).agg(F.max("ts_ms").alias("last_ms"), F.count("*").alias("n"), F.max("sev").alias("sev"))
    return health.top(health.hypotheses(g, F.col("sev"), "last_ms", "n", _NOW), "score", "cause", 6).select("cause", "n", "last_ms", "score", "rank")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine samples made of events: a session per user, an hour of it as ten seconds."""
    return events(spark, sf_dir).select("source", (F.col("ts_ms") / 360_000.0).alias("ts_s"), (F.col("value") % 110).alias("temp"), F.lit("cpu package").alias("temp_label"), (F.col("event_id") % 7).cast("double").alias("fan_rpm"), (11.0 + (F.col("event_id") % 11) / 10.0).alias("volts"), F.col("value").alias("watts"))


@query(f"""WITH {EV}, s AS (SELECT source, ts_ms / 360000.0::DOUBLE AS ts_s, value % 110 AS temp, event_id % 7 AS fan, 11.0::DOUBLE + (event_id % 11) / 10.0::DOUBLE AS volts, value AS watts FROM ev),
e AS (SELECT *, max(ts_s) OVER (PARTITION BY source) AS fin, row_number() OVER (PARTITION BY source ORDER BY ts_s) AS i, count(*) OVER (PARTITION BY source) AS n FROM s),
f AS (SELECT source, max(temp - 95) FILTER (WHERE fin - ts_s <= 120) AS o, arg_max(temp, ts_s) FILTER (WHERE fin - ts_s <= 300) AS t1, arg_min(temp, ts_s) FILTER (WHERE fin - ts_s <= 300) AS t0,
 max(CASE WHEN fan = 0 AND temp >= 80 THEN 1 ELSE 0 END) AS fs, min(volts - 11.4::DOUBLE) FILTER (WHERE i > n / 2) AS gap, min(volts) FILTER (WHERE i > n / 2) AS vl, median(volts) AS vm, max(watts) FILTER (WHERE fin = ts_s) AS wl,
 median(watts) FILTER (WHERE fin > ts_s AND fin - ts_s <= 600) AS wm, count(*) FILTER (WHERE fin - ts_s <= 600) AS wn FROM e GROUP BY 1),
p AS (SELECT source, 'thermal' AS cause, 3.0::DOUBLE AS points FROM f WHERE o >= 0 UNION ALL SELECT source, 'thermal', 2 FROM f WHERE t1 - t0 >= 10 AND t1 >= 85 UNION ALL SELECT source, 'fan_failure', 3 FROM f WHERE fs = 1
 UNION ALL SELECT source, 'psu_power', 3 FROM f WHERE gap < 0 UNION ALL SELECT source, 'psu_power', 2 FROM f WHERE coalesce(gap, 0) >= 0 AND vm - vl >= 0.04::DOUBLE * vm UNION ALL SELECT source, 'psu_power', 2 FROM f WHERE wn >= 5 AND wl >= 1.5 * wm),
g AS (SELECT source, cause, sum(points) AS score FROM p GROUP BY 1, 2)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, cause) AS INTEGER) AS rank, cause, score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2.5 THEN 'medium' ELSE 'low' END AS confidence FROM g""")
def crash_verdict(spark, sf_dir):
    return hardware.verdict(hardware.telemetry_points(samples(spark, sf_dir), ["source"]), ["source"]).select("source", "rank", "cause", "score", "confidence")


@query("""WITH d AS (SELECT doc_id, n_chars, CASE WHEN source IN ('src0', 'src1') THEN 1 ELSE 0 END AS tier, CAST(doc_id % 10 AS DOUBLE) / 10 AS interest FROM documents), u AS (SELECT sum(n_chars) AS used FROM d),
r AS (SELECT *, sum(n_chars) OVER (ORDER BY tier, interest, doc_id) - n_chars AS before FROM d)
SELECT doc_id, n_chars, tier, CAST(before AS BIGINT) AS freed_before FROM r, u WHERE used >= 0.9 * 1000000 AND used - before > 0.75 * 1000000""")
def retention_evict(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", ((F.col("doc_id") % 10).cast("double") / 10).alias("interest"), "source")
    out = retention.eviction(d, "n_chars", F.when(F.col("source").isin("src0", "src1"), 1).otherwise(0), "interest", "doc_id", "doc_id", 1_000_000)
    return out.select("doc_id", "n_chars", "tier", "freed_before")


@query("""WITH f AS (SELECT d.doc_id, l.toxic = 1 AS e, l.quality = 0 AS k, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS s FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT *, CASE WHEN e THEN 0 WHEN k THEN 1 WHEN s >= 0.25 THEN 2 WHEN s >= 0.008 THEN 3 ELSE 4 END AS priority FROM f)
SELECT doc_id, CAST(priority AS INTEGER) AS priority, round(least(1.0::DOUBLE, CASE priority WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 WHEN 2 THEN 0.6 WHEN 3 THEN 0.35 ELSE 0.05 END + least(0.1::DOUBLE, s / 10)), 4) AS interest, priority <= 3 AS needs_eyes FROM p""")
def frame_assess(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    no = F.lit(False)
    priority, interest, eyes = retention.assess(F.col("toxic") == 1, no, F.col("quality") == 0, no, (F.col("n_chars") % 100).cast("double") / 100, no)
    return d.select("doc_id", priority.alias("priority"), interest.alias("interest"), eyes.alias("needs_eyes"))


@query("""WITH b AS (SELECT vec_id, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1::HUGEINT ELSE 0::HUGEINT END)), lambda a, x: a * 2 + x) AS UBIGINT) AS h FROM embeddings)
SELECT a.vec_id, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM b a JOIN b ON b.vec_id = a.vec_id + 1""")
def hamming_pairs(spark, sf_dir):
    h = table(spark, sf_dir, "embeddings").select("vec_id", F.lpad(F.hex(visual.sign_hash(F.col("embedding"))), 16, "0").alias("h"))
    nxt = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("h2"))
    return h.join(nxt, "vec_id").select("vec_id", visual.hamming(F.col("h"), F.col("h2")).cast("int").alias("distance"))


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 100) AS BIGINT)) AS g FROM embeddings),
d AS (SELECT a.vec_id, list_transform(list_zip(a.g, b.g), lambda p: abs(p[1] - p[2])) AS d FROM g a JOIN g b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(len(list_filter(d, lambda x: x >= 8)) / len(d), 4) AS change_score, round(list_sum(d) / len(d), 4) AS mean_abs, CAST(list_max(d) AS DOUBLE) AS max_abs, CAST(len(list_filter(d, lambda x: x >= 8)) AS INTEGER) AS n_changed FROM d""")
def grid_diff(spark, sf_dir):
    g = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100)).alias("g"))
    nxt = g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("g2"))
    return g.join(nxt, "vec_id").select("vec_id", visual.grid_diff(F.col("g"), F.col("g2")).alias("d")).select("vec_id", "d.*")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), h AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM h)
SELECT doc_id, round(-sum(p * log2(p)), 4) AS bits FROM p GROUP BY 1""")
def entropy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", F.round(visual.text_entropy(F.col("text")), 4).alias("bits"))


@query("SELECT e.event_id, j.key AS path, json_extract_string(e.props, '$.' || j.key) AS value FROM events e, json_each(e.props) j")
def flatten_json(spark, sf_dir):
    return state.flatten(table(spark, sf_dir, "events").select("event_id", "props"), ["event_id"], "props").select("event_id", "path", "value")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.message'), json_extract_string(props, '$.msg'), json_extract_string(props, '$.k')) AS message, coalesce(json_extract_string(props, '$.level'), 'INFO') AS level FROM events""")
def json_alias_parse(spark, sf_dir):
    g = lambda k: F.get_json_object("props", f"$.{k}")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(g("message"), g("msg"), g("k")).alias("message"), F.coalesce(levels.canonical_level(g("level")), F.lit("")).alias("_l")).select("event_id", "message", F.when(F.col("_l") == "", "INFO").otherwise(F.col("_l")).alias("level"))


@query(rf"""WITH {DOC_LINES}, s AS (SELECT source, trim(regexp_replace(regexp_replace(lower(line), '^\[[^\]]*\]\s*', ''), '[0-9]+', 'N', 'g')) AS signature, count(*) AS n FROM dl GROUP BY 1, 2)
SELECT signature, any_value(source) AS label, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1 HAVING count(*) = 1""")
def source_exclusive_signatures(spark, sf_dir):
    return timeline.exclusive_signatures(document_lines(spark, sf_dir), "source", "line")


@query(f"WITH {EV} SELECT source, count(*) FILTER (WHERE category = 'error') AS failed, count(*) FILTER (WHERE category = 'purchase') AS succeeded FROM ev GROUP BY 1 HAVING failed > 0 AND succeeded > 0")
def recovery_report(spark, sf_dir):
    return errors.recovery(events(spark, sf_dir), "source", F.col("category") == "error", F.col("category") == "purchase")


@query(f"""WITH {EV} SELECT event_id, ts_ms, 'errors' AS watch FROM ev WHERE category = 'error' UNION ALL SELECT event_id, ts_ms, 'user_3' FROM ev WHERE source = 'user_3'
UNION ALL SELECT event_id, ts_ms, 'k7' FROM ev WHERE level = 'INFO' AND regexp_matches(props, '(?i)"k": 7[0-9]')""")
def watch_hits(spark, sf_dir):
    watches = [{"name": "errors", "category": "error"}, {"name": "user_3", "source": "user_3"}, {"name": "k7", "level": "INFO", "regex": '"k": 7[0-9]'}]
    return signals.watch_hits(events(spark, sf_dir), watches).select("event_id", "ts_ms", "watch")


_RANK = "CASE level WHEN 'ERROR' THEN 5 WHEN 'WARN' THEN 4 WHEN 'INFO' THEN 3 WHEN 'DEBUG' THEN 2 ELSE 1 END"


@query(f"""WITH {EV}, r AS (SELECT event_id, source, ts_ms, {_RANK} AS rank, max({_RANK}) OVER (PARTITION BY source ORDER BY ts_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ev)
SELECT event_id, source, ts_ms, CAST(rank AS INTEGER) AS rank FROM r WHERE b IS NULL OR rank > b""")
def signal_suppression(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("rank", levels.level_rank(F.col("level")))
    return signals.unsuppressed(e, ["source"], ["ts_ms", "event_id"], "rank").select("event_id", "source", "ts_ms", "rank")


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT source, ts_ms, event_id, row_number() OVER (PARTITION BY source ORDER BY ts_ms, event_id) AS i FROM ev),
g AS (SELECT source, i, ts_ms, event_id, ts_ms AS last, true AS ok FROM o WHERE i = 1
 UNION ALL SELECT o.source, o.i, o.ts_ms, o.event_id, CASE WHEN o.ts_ms - g.last >= {DAY} THEN o.ts_ms ELSE g.last END, o.ts_ms - g.last >= {DAY} FROM g JOIN o ON o.source = g.source AND o.i = g.i + 1)
SELECT source, ts_ms, event_id FROM g WHERE ok""")
def rate_limited(spark, sf_dir):
    return sequence.rate_limited(events(spark, sf_dir), "source", "ts_ms", "event_id", DAY)


@query(f"WITH {EV} SELECT level, category, ts_ms // {DAY} AS day, count(*) AS n, CAST(grouping(level, category, ts_ms // {DAY}) AS BIGINT) AS grouping_id FROM ev GROUP BY ROLLUP (level, category, ts_ms // {DAY})")
def level_source_rollup(spark, sf_dir):
    return health.rollup(events(spark, sf_dir).select("level", "category", F.floor(F.col("ts_ms") / DAY).cast("long").alias("day")), "level", "category", "day")


@query("SELECT c_custkey, n_name, r_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dim_lookup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "n_name", "r_name", "c_mktsegment")


_TOKENS = "(SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS t FROM {})"


@query(f"WITH c AS {_TOKENS.format('conversations')}, d AS {_TOKENS.format('documents')} SELECT c.t AS token, d.t IS NOT NULL AS corroborated FROM c LEFT JOIN d ON c.t = d.t WHERE length(c.t) >= 4")
def corroborate_tokens(spark, sf_dir):
    tok = lambda name: table(spark, sf_dir, name).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token"))
    return roles.corroborated(tok("conversations").distinct().filter(F.length("token") >= 4), "token", tok("documents"), "token")


@query(f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts_ms, event_id) AS i FROM ev) SELECT event_id, source, ts_ms FROM r WHERE (i - 1) % 5 = 0")
def replay_every_nth(spark, sf_dir):
    return sequence.every_nth(events(spark, sf_dir), ["source"], ["ts_ms", "event_id"], 5).select("event_id", "source", "ts_ms")


@query(f"""WITH {EV}, a AS (SELECT DISTINCT source FROM ev WHERE category = 'error' AND ts_ms // {DAY} = 19732), b AS (SELECT DISTINCT source FROM ev WHERE category = 'error' AND ts_ms // {DAY} = 19733)
SELECT source, 'resolved' AS change FROM (SELECT source FROM a EXCEPT SELECT source FROM b) UNION ALL SELECT source, 'new' FROM (SELECT source FROM b EXCEPT SELECT source FROM a)""")
def new_resolved_errors(spark, sf_dir):
    e = events(spark, sf_dir).filter(F.col("category") == "error").withColumn("day", F.floor(F.col("ts_ms") / DAY))
    return errors.difference(e.filter(F.col("day") == 19732), e.filter(F.col("day") == 19733), "source")


@query(f"WITH {EV} SELECT event_id, source, round(value - lag(value) OVER (PARTITION BY source ORDER BY ts_ms, event_id), 4) AS delta FROM ev")
def stat_delta(spark, sf_dir):
    return sequence.deltas(events(spark, sf_dir), ["source"], ["ts_ms", "event_id"], "value", 10 * DAY).select("event_id", "source", "delta")


@query(f"WITH {EV}, r AS (SELECT event_id, source, sum(CASE WHEN category = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ts_ms, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM ev) SELECT event_id, source FROM r WHERE n = 3")
def error_run(spark, sf_dir):
    return sequence.error_runs(events(spark, sf_dir), ["source"], ["ts_ms", "event_id"], F.col("category") == "error").select("event_id", "source")


@query(f"WITH {EV}, r AS (SELECT source, CASE WHEN props IS DISTINCT FROM lag(props) OVER w OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS x FROM ev WHERE category = 'error' WINDOW w AS (PARTITION BY source ORDER BY ts_ms, event_id)) SELECT source, CAST(sum(x) AS BIGINT) AS occurrences FROM r GROUP BY 1")
def occurrence_registry(spark, sf_dir):
    return errors.occurrences(events(spark, sf_dir).filter(F.col("category") == "error"), "source", ["ts_ms", "event_id"], "props")


@query(f"""WITH {EV}, r AS (SELECT user_id % 40 AS site, ts_ms // {DAY} AS run_ms, category = 'signup' AS s, CAST(json_extract(props, '$.k') AS BIGINT) AS n FROM ev),
p AS (SELECT site, run_ms, coalesce(max(n) FILTER (WHERE s), sum(n) FILTER (WHERE NOT s)) AS n FROM r GROUP BY 1, 2)
SELECT site, max(run_ms) AS run_ms, CAST(arg_max(n, run_ms) AS BIGINT) AS n FROM p GROUP BY 1""")
def swallowed_exceptions(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 40).alias("site"), F.floor(F.col("ts_ms") / DAY).cast("long").alias("run_ms"), F.when(F.col("category") == "signup", "summary").otherwise("live").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("n"))
    return errors.swallowed(e)


@query(f"""WITH {EV} SELECT source, max(ts_ms) FILTER (WHERE category <> 'view') AS last_ms, count(*) FILTER (WHERE category = 'view') AS self_emitted, count(*) FILTER (WHERE ts_ms IS NULL) AS untimed, count(*) AS n,
{_NOW} - max(ts_ms) FILTER (WHERE category <> 'view') AS age_ms, coalesce({_NOW} - max(ts_ms) FILTER (WHERE category <> 'view') > {DAY}, true) AS stale FROM ev GROUP BY 1""")
def source_freshness(spark, sf_dir):
    return health.freshness(events(spark, sf_dir), "source", "ts_ms", F.col("category") == "view", _NOW, DAY)


@query(f"""WITH {EV}, c AS (SELECT source, ts_ms, event_id, CASE WHEN value < 20 THEN 'identical' WHEN value < 40 THEN 'minor_change' ELSE 'changed' END AS change FROM ev),
m AS (SELECT *, CASE WHEN change = lag(change) OVER w AND change IN ('identical', 'minor_change') THEN 0 ELSE 1 END AS s FROM c WINDOW w AS (PARTITION BY source ORDER BY ts_ms, event_id)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY source ORDER BY ts_ms, event_id) AS BIGINT) AS island FROM m)
SELECT source, island, any_value(change) AS change, min(ts_ms) AS first_seq, max(ts_ms) AS last_seq, count(*) AS frames FROM i GROUP BY 1, 2""")
def visual_change_runs(spark, sf_dir):
    score = F.when(F.col("value") < 20, 0.0).when(F.col("value") < 40, 0.004).otherwise(0.1)
    return visual.change_runs(events(spark, sf_dir).withColumn("score", score), ["source"], ["ts_ms", "event_id"], "score")


@query(f"""WITH {EV}, m AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < {65_001} THEN 0 ELSE 1 END AS s FROM ev WHERE category = 'error' WINDOW w AS (PARTITION BY source ORDER BY ts_ms)),
i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY source ORDER BY ts_ms) AS BIGINT) AS session FROM m)
SELECT source, session, min(ts_ms) - 60000 AS from_ms, max(ts_ms) + 5000 AS to_ms, count(*) AS triggers FROM i GROUP BY 1, 2""")
def incident_windows(spark, sf_dir):
    return signals.incidents(events(spark, sf_dir).filter(F.col("category") == "error"), "ts_ms", ["source"])


@query("""SELECT doc_id, CASE WHEN n_chars < 100 THEN 'not_running' WHEN lang = 'de' AND n_chars > 4000 THEN 'error,recurring' WHEN lang = 'de' THEN 'error' WHEN lang = 'fr' THEN 'stuck' WHEN lang = 'es' THEN 'anomaly' ELSE 'healthy' END AS tag,
CASE WHEN n_chars < 100 THEN 0.3 WHEN lang = 'de' THEN 0.2 WHEN lang = 'fr' THEN 0.5 WHEN lang = 'es' THEN 0.6 ELSE 0.85 END::DOUBLE AS confidence FROM documents""")
def frame_triage(spark, sf_dir):
    tag, confidence = retention.triage(F.col("n_chars") >= 100, F.col("lang") == "de", F.when(F.col("n_chars") > 4000, 2).otherwise(1), F.col("lang") == "fr", F.col("lang") == "es", F.lit(None).cast("double"), F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", tag.alias("tag"), confidence.alias("confidence"))


@query("SELECT CASE WHEN toxic = 1 THEN 'pinned' WHEN quality = 0 THEN 'expired' ELSE 'cleared' END AS state, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def ledger_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return retention.ledger_report(d, "n_chars", F.when(F.col("toxic") == 1, "pinned").when(F.col("quality") == 0, "expired").otherwise("cleared"))


@query("SELECT doc_id, CAST(ceil(n_chars / 4) AS BIGINT) AS tokens, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars / 1024.0::DOUBLE, 1)) WHEN n_chars < 1073741824 THEN printf('%.1f MB', round(n_chars / 1048576.0::DOUBLE, 1)) ELSE printf('%.1f GB', round(n_chars / 1073741824.0::DOUBLE, 1)) END AS size FROM documents")
def token_report(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.text_tokens(F.col("n_chars")).alias("tokens"), text.human_size(F.col("n_chars")).alias("size"))


def content_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of documents and pages as a log of what it holds would name it: addresses are digests of the line and of the whole text, so texts that repeat share them."""
    d = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    p = table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    short = lambda c: F.substring(F.md5(F.col(c).cast("binary")), 1, 10)
    lines = d.unionByName(p).select("origin", "id", short("text").alias("of"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    return lines.select("origin", "id", "line_no", F.concat(F.lit("origin="), "origin", F.lit(" text=0x"), "of", F.lit(" part=0x"), short("line"), F.lit(" length="), F.length("line").cast("string")).alias("line"))


_CONTENT = r"""raw AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') FROM pages),
cut AS (SELECT origin, id, substr(md5(text), 1, 10) AS of, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM raw),
cl AS (SELECT origin, id, line_no, of, substr(md5(l), 1, 10) AS part, 'origin=' || origin || ' text=0x' || of || ' part=0x' || substr(md5(l), 1, 10) || ' length=' || length(l) AS line FROM cut WHERE trim(l) <> ''),
named AS (SELECT origin, id, line_no, line, 'text' AS role, of AS h FROM cl UNION ALL SELECT origin, id, line_no, line, 'part', part FROM cl),
ri AS (SELECT '0x' || CASE WHEN ltrim(h, '0') = '' THEN '0' ELSE ltrim(h, '0') END AS address, role, count(*) AS n, arg_min(line, (origin, id, line_no)) AS first_line, arg_max(line, (origin, id, line_no)) AS last_line FROM named GROUP BY 1, 2)"""


@query(f"WITH {_CONTENT} SELECT address, role, CAST(n AS BIGINT) AS n, first_line, last_line FROM ri")
def content_role_index(spark, sf_dir):
    return roles.address_roles(content_lines(spark, sf_dir), "line", order=["origin", "id", "line_no"])


@query(f"WITH {_CONTENT} SELECT address, CAST(sum(n) AS BIGINT) AS total, count(*) AS roles FROM ri GROUP BY 1 HAVING count(*) FILTER (WHERE role = 'part') = 0")
def content_roles_never(spark, sf_dir):
    """Texts that stand as no line of another."""
    return roles.never(roles.address_roles(content_lines(spark, sf_dir), "line", order=["origin", "id", "line_no"]), "part")


@without_sql
def text_role_index(spark, sf_dir):
    return roles.address_roles(text_lines(spark, sf_dir), "line", order=["origin", "id", "line_no"])


@without_sql
def text_roles_never(spark, sf_dir):
    return roles.never(roles.address_roles(text_lines(spark, sf_dir), "line", order=["origin", "id", "line_no"]), "dst")


@without_sql
def detect_format(spark, sf_dir):
    return parsing.detect(document_lines(spark, sf_dir), "source", "line", ["doc_id", "line_no"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import evidence, telemetry, texts  # noqa: F401  they add theirs

    return QUERIES | WITHOUT_SQL


def oracle_sql() -> dict[str, str]:
    from . import evidence, telemetry, texts  # noqa: F401

    return dict(SQL)
